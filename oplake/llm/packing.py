"""Best-fit packing of tokenised documents into training sequences, by vector best fit."""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oplake.llm.common import scratch

#: How the byte-level BPE of the vocabulary file splits text before merging (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _file(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def _exact(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(_file(name))


@functools.lru_cache(maxsize=4)
def _added(name: str) -> re.Pattern | None:
    """What the vocabulary reads as one token of its own wherever it stands in a text."""
    found = [t.content for t in _exact(name).get_added_tokens_decoder().values()]
    return re.compile("|".join(map(re.escape, sorted(found, key=len, reverse=True)))) if found else None


@functools.lru_cache(maxsize=4)
def _fast(name: str):
    """The same vocabulary in the faster library, or None where its rank file is missing."""
    import base64
    import os

    import tiktoken

    ranks = os.path.splitext(_file(name))[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return None
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})


def encode(text: str, tokenizer: str) -> list[int]:
    """Token ids as ``tokenizers`` gives them, without special tokens added; a string in the text that
    names an added token is that token.  Latin-1 texts without such a string go through the faster
    library with the same vocabulary, which the tests hold to the same ids; others, whose character
    classes the two could see differently, go through ``tokenizers`` itself."""
    fast, added = _fast(tokenizer), _added(tokenizer)
    if fast is not None and not (added and added.search(text)):
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pass
        else:
            return fast.encode_ordinary(text)
    return _exact(tokenizer).encode(text, add_special_tokens=False).ids


#: Bins of a bucket that are packed again, at most.
LOOSE = 64


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_attention: int, weights=(1.0, 0.02, 0.02), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, placed longest first into the open bin that fits it best
    under all three capacities: tokens, documents and attention cost (sum of squared lengths).

    ``norm`` takes the bin whose weighted residual vector is shortest after placement, ``dot``
    the one whose residual has the largest weighted dot product with the item.
    """
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    bins, at = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    scale = np.array([capacity, max_docs, max_attention], dtype=np.float64)
    w = np.asarray(weights, dtype=np.float64)
    left = np.empty((3, 256), dtype=np.float64)  # residuals of bins that still have room
    ids = np.empty(256, dtype=np.int64)
    used = opened = 0
    smallest = int(lengths[order[-1]]) if n else 0
    for k in order:
        need = np.array([lengths[k], 1.0, float(lengths[k]) ** 2])
        pick = -1
        if used:
            room = left[:, :used]
            ok = np.flatnonzero((room[0] >= need[0]) & (room[1] >= 1.0) & (room[2] >= need[2]))
            if len(ok):
                if rule == "dot":
                    pick = int(ok[np.argmax((w * need / scale**2) @ room[:, ok])])
                else:
                    rest = (room[:, ok] - need[:, None]) / scale[:, None]
                    pick = int(ok[np.argmin(w @ (rest * rest))])
        if pick < 0:
            if used == left.shape[1]:
                left, ids = np.concatenate([left, np.empty_like(left)], axis=1), np.concatenate([ids, np.empty_like(ids)])
            pick, used = used, used + 1
            left[:, pick], ids[pick] = scale, opened
            opened += 1
        bins[k], at[k] = ids[pick], capacity - int(left[0, pick])
        left[:, pick] -= need
        if left[0, pick] < smallest or left[1, pick] < 1 or left[2, pick] < float(smallest) ** 2:
            used -= 1
            left[:, pick], ids[pick] = left[:, used], ids[used]
    return bins, at


def pack_documents(docs: DataFrame, capacity: int = 2048, max_docs: int = 2048, max_attention: int | None = None, rule: str = "norm", tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, bucket_pieces: int = 4096, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ``ids``).

    A document is its token ids and one ``end_id``; null text is empty, so its document is that
    one id.  Longer ones than ``capacity`` are cut so that only the first piece is short.
    Repeated rows are packed each; an empty table gives no rows; other columns are ignored.
    Pieces are dealt evenly into buckets of about ``bucket_pieces``, packed apart.  A bucket's bins
    under 99 % full, the LOOSE emptiest of them, are packed again with those of 63 others, and so
    on until one bucket is left: sizes are spread alike over buckets, so what more of its bins stay
    open is no loss to bucketing.  ``max_attention`` has to admit one full piece, so its default,
    ``capacity`` squared, weighs on the choice of bins alone; lower ``max_docs`` to bind it.
    """
    if capacity < 1 or max_docs < 1:
        raise ValueError("capacities must be positive")
    most = max_attention if max_attention is not None else capacity * capacity
    if most < capacity * capacity:
        raise ValueError("max_attention must admit one full piece")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = 0
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "slot", "ids")}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array(encode(text.as_py() or "", tokenizer) + [end_id], dtype="<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for p, (a, b) in enumerate(zip(edges, edges[1:])):
                    slot += 1
                    raw = ids[a:b].tobytes()
                    out["doc_id"].append(doc)
                    out["piece"].append(p)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    out["ids_crc32"].append(crc := zlib.crc32(raw))
                    out["slot"].append((crc + slot * 2654435761) & 0x7FFFFFFF)
                    out["ids"].append(ids[a:b].astype(np.int32) if with_ids else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], batch.schema.field(0).type), pa.array(out["piece"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32", "slot")), pa.array(out["ids"], pa.list_(pa.int32()))],
                names=list(out),
            )

    fields = "piece int, start long, length long, ids_crc32 long, slot long, ids array<int>"
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    cut = scratch(source.mapInArrow(pieces, f"doc_id {kind}, {fields}"), "pack-pieces")
    buckets = max(1, math.ceil(cut.count() / bucket_pieces))
    cut = cut.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would turn ids beside a null into floats
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long, ids array<int>, bucket long, sequence_id long, offset long, loose boolean"

    def packer(level: int, last: bool):
        def pack(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
            sizes, b = part["length"].to_numpy(), int(part["bucket"].iloc[0])
            bins, at = best_fit(sizes, capacity, max_docs, most, rule=rule)
            fill = np.bincount(bins, weights=sizes)
            part["sequence_id"] = bins + (b << 32) + (level << 58)
            part["offset"] = at
            again = np.zeros(len(fill), dtype=bool)
            again[np.argsort(fill, kind="stable")[:LOOSE]] = not last
            part["loose"] = (again & (fill < 0.99 * capacity))[bins]
            return part[["doc_id", "piece", "start", "length", "ids_crc32", "ids", "bucket", "sequence_id", "offset", "loose"]]

        return pack

    level = 0
    once = cut.withColumn("bucket", F.pmod(F.col("slot"), F.lit(buckets))).groupBy("bucket").applyInPandas(packer(0, buckets == 1), schema)
    done = []
    while buckets > 1:
        buckets, level = math.ceil(buckets / 64), level + 1
        once = scratch(once, "pack-once")
        done.append(once.where("not loose"))
        again = once.where("loose").drop("sequence_id", "offset", "loose").withColumn("bucket", F.floor(F.col("bucket") / 64))
        once = again.groupBy("bucket").applyInPandas(packer(level, buckets == 1), schema)
    once = functools.reduce(DataFrame.unionByName, [once, *done])
    out = once.select(F.col("doc_id").cast(kind).alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
    return out

"""The stages against what each operator says about its own input, and the entry's registry."""

import collections
import zlib

import __spark_entry__
import corpus_pipeline
import numpy as np
from oplake.llm import jaccard, mixing, quality, toxicity

from tests.llm.test_search import WORD, brute_components


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := str(tmp_path / str(k)))
        out = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        counts.append((docs, out))
        docs = out
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ids = lambda df: collections.Counter(r.doc_id for r in df.select("doc_id").collect())
    a, b = counts[0]
    assert ids(b) == ids(quality.score_documents(a, quality.fit(a, labels)).where("predicted = 1"))
    a, b = counts[1]
    assert ids(b) == ids(toxicity.score_documents(a, toxicity.fit(a, labels)).where("toxic = 0"))
    a, b = counts[2]
    assert ids(b) == ids(jaccard.similarity_components(a).where("doc_id = component_id"))
    a, b = counts[3]
    assert ids(b) == collections.Counter({r.doc_id: r.copies for r in mixing.mix_sources(a).collect() if r.copies})
    a, b = counts[4]
    assert {r.doc_id for r in b.collect()} == {r.doc_id for r in a.collect()}


def test_stages_by_brute_force(spark, sf_dir, corpus):
    """What the stages keep, take and pack, worked out again document by document."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = {d[0]: d[1] for d in corpus[0]}
    stage = dict(corpus_pipeline.STAGES)
    # quality and toxicity: the scores themselves are held to brute force in test_learned
    model = quality.fit(docs, labels)
    scores = {r.doc_id: r.score for r in quality.score_documents(docs, model).collect()}
    assert {r.doc_id for r in stage["quality classifier"](spark, docs, sf_dir).collect()} == {i for i, s in scores.items() if s >= 0.3}
    model = toxicity.fit(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    assert {r.doc_id for r in stage["toxicity"](spark, docs, sf_dir).collect()} == {i for i, s in scores.items() if s < 0.5}
    # near duplicates: all pairs compared
    groups = brute_components(list(texts.items()))
    kept = [r.doc_id for r in stage["n-gram jaccard join"](spark, docs, sf_dir).collect()]
    assert sorted(kept) == sorted(i for i, (_, first) in groups.items() if first == i)
    # mixing: whole copies, three at most, each source as near its target as its lengths allow
    sizes = {i: len(WORD.findall(t or "")) for i, t in texts.items()}
    source = {d[0]: d[3] for d in corpus[0]}
    copies = collections.Counter(r.doc_id for r in stage["mixing sources"](spark, docs, sf_dir).collect())
    names = sorted(set(source.values()))
    own = {s: sum(sizes[i] for i in sizes if source[i] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        rest = sum(own.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * own[s]}
        target |= {s: 3.0 * own[s] for s in full} or share
        open_ = open_ - full if full else set()
    assert max(copies.values()) <= 3
    for s in names:
        taken = sum(n * sizes[i] for i, n in copies.items() if source[i] == s)
        assert abs(taken - target[s]) <= 1 or abs(taken - target[s]) < min(z for i, z in sizes.items() if z and source[i] == s)
    # packing: the ids of the plain tokenizer, cut and placed without gap or overlap
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in stage["best-fit packing"](spark, docs, sf_dir).collect():
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, t in texts.items():
        ids = exact.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want = [(a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for a, b in zip(cuts, cuts[1:])]
        assert [(r.start, r.length, r.ids_crc32) for r in sorted(pieces[i], key=lambda r: r.piece)] == want
    for own_ in bins.values():
        at = 0
        for offset, length in sorted(own_):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) + 2


def test_registry():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names


def test_stages_on_odd_tables(spark, sf_dir):
    """An empty table, and null, repeated and clashing rows and columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(None, None, None, None, None, 1, 2), (3, "a b c d e f", "en", None, 1, 1, 2), (3, "a b c d e f", "en", None, 1, 1, 2), (4, "", None, "s", 0, 1, 2)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, copies int")
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0 and (name == "best-fit packing" or empty.columns == docs.columns)
        out = stage(spark, odd, sf_dir)
        assert out.count() <= 3 * len(rows) and (name == "best-fit packing" or out.columns == odd.columns)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 100 and "sequence_id" in out.columns


def test_texts_go_to_workers_in_short_batches(spark, sf_dir):
    """Each stage that sends whole texts to Python does so in batches of 1000 rows, unless the session chose a number."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(key)
    try:
        for name, stage in corpus_pipeline.STAGES[:3]:
            for given, then in (("10000", "1000"), ("77", "77")):
                spark.conf.set(key, given)
                stage(spark, docs.limit(0), sf_dir)
                assert spark.conf.get(key) == then, name
    finally:
        spark.conf.set(key, held)

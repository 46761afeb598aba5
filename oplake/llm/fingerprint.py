"""I-Match document fingerprints, with DataFrame functions only.

Terms whose inverse document frequency lies within a band form the lexicon.  A document's
distinct lexicon terms are sorted and hashed whole, and hashed again under randomised subsets of
the lexicon, each of which drops terms at random.  How many it drops follows the number of the
document's terms, so that a subset holds about one of them and half-changed texts still share
subsets; sparser versions of the same subsets let documents of other lengths compare.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oplake.llm.common import WORD  # noqa: F401  the word rule below is its complement

#: Randomised subsets of the lexicon, drawn eight at a time: the eight of a draw share no term from
#: level 3 on, those of different draws are independent.
SUBSETS, DRAWN = 32, 3
#: A subset at level l keeps each term with probability 2^-l.  A document is hashed at its own level, at
#: which a subset holds one term of it or a little less, and at the next ones, up to 2^LEVELS times its terms.
LEVELS = 8
#: Share of documents that hold a lexicon term: the band of inverse document frequency.
BAND = (0.002, 0.2)
_CELL, _WHOLE = 4, 16  # hex digits of a subset's hash, and of the whole lexicon's
#: Key ranges in which texts meet their successors, at most; a larger table has larger ranges, which sorts spill.
RANGES = 1 << 16


def term_hashes(text: Column) -> Column:
    """Distinct hashes of the lower-cased words."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def _constant(values: list[int], kind: str) -> Column:
    """A constant array, folded once by the optimizer."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` and the lambdas in it name it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lexicon(docs: DataFrame, text_col: str, n_docs: int, band=BAND) -> list[int]:
    """Hashes of the terms within the band.  Counts run over all documents; as a lexicon term stands in
    a share of band[0] of them at least, there are no more than a document's mean number of distinct
    terms over band[0], however large the table."""
    df = docs.select(F.explode(term_hashes(F.col(text_col))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    inside = df.where((F.col("df") >= band[0] * n_docs) & (F.col("df") <= max(1.0, band[1] * n_docs)))
    return [r.h for r in inside.select("h").collect()]


def _cuckoo(words: list[int]) -> list[int]:
    """A table, a little over twice as long as the words, in which each word stands at one of two places,
    by the rest it or its higher bits leave.  Free slots repeat a word, which changes no answer."""
    size = 4 + 22 * len(words) // 10
    while True:
        table: dict[int, int] = {}
        for word in words:
            now, at = word, word % size
            for _ in range(500):
                now, other = table.get(at), now
                table[at] = other
                if now is None:
                    break
                at = (now >> 20) % size if at == now % size else now % size
            if now is not None:
                break
        else:
            return [table.get(i, words[0]) for i in range(size)]
        size += 1 + size // 8


def _members(terms: Column, words: list[int]) -> Column:
    """The terms that are among ``words``, by two looks at a constant table each.  The table stands in
    the plan once, as plans are printed and kept."""
    if not words:
        return F.filter(terms, lambda h: F.lit(False))
    table = _cuckoo(words)

    def known(values: Column, h: Column) -> Column:
        first, other = (F.element_at(values, F.pmod(x, F.lit(len(table))).cast("int") + 1) for x in (h, F.shiftright(h, 20)))
        return (first == h) | (other == h)

    return _let(_constant(table, "bigint"), lambda values: F.filter(terms, lambda h: known(values, h)))


def with_fingerprint(df: DataFrame, text_col: str, out_col: str, words: list[int]) -> DataFrame:
    """Adds the fingerprint of ``text_col``: two hex digits of the level, sixteen of the hash of all
    its lexicon terms, then for each of LEVELS levels from its own on SUBSETS hashes of four digits,
    0000 for a subset without terms; zeros at the end are left off.  Texts none of whose terms is in
    the lexicon are hashed by all their terms."""
    t, kept, level = "__fp_terms", "__fp_kept", "__fp_level"
    df = df.withColumn(t, term_hashes(F.coalesce(F.col(text_col), F.lit(""))))
    df = df.withColumn(kept, _members(F.col(t), words))
    df = df.withColumn(kept, F.array_sort(F.when(F.size(kept) > 0, F.col(kept)).otherwise(F.col(t)))).drop(t)
    df = df.withColumn(level, F.when(F.size(kept) > 1, F.ceil(F.log2(F.size(kept).cast("double"))).cast("int")).otherwise(F.lit(0)))

    def mask(bits: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

    # a draw gives each term a hash u: its lowest bits name the term's subset, or several at low
    # levels, and the bits above have to be zero, one more at each level
    def of_subset(u: Column, i: Column, at: Column) -> Column:
        low = mask(F.least(at, F.lit(DRAWN)))
        return u.bitwiseAND(low) == i.cast("long").bitwiseAND(low)

    def of_level(u: Column, at: Column) -> Column:
        return F.shiftrightunsigned(u, DRAWN).bitwiseAND(mask(F.greatest(at, F.lit(DRAWN)) - DRAWN)) == 0

    draws, each = F.sequence(F.lit(0), F.lit((SUBSETS >> DRAWN) - 1)), F.sequence(F.lit(0), F.lit((1 << DRAWN) - 1))
    drawn = F.transform(draws, lambda g: F.filter(F.col(kept), lambda h: of_level(F.xxhash64(h, g), F.col(level))))
    own = F.flatten(F.transform(drawn, lambda terms, g: F.transform(each, lambda i: F.filter(terms, lambda h: of_subset(F.xxhash64(h, g), i, F.col(level))))))
    none = F.lit("0" * _CELL)

    def cell(terms: Column, i: Column, j: Column) -> Column:
        g, at = F.shiftright(i, DRAWN), F.col(level) + j
        mine = F.filter(terms, lambda h: of_subset(F.xxhash64(h, g), i, at) & of_level(F.xxhash64(h, g), at))
        code = _let(mine, lambda m: F.when(F.size(m) > 0, F.lpad(F.hex(F.pmod(F.xxhash64(m), F.lit(0xFFFF)) + 1), _CELL, "0")).otherwise(none))
        return F.when(F.size(terms) > 0, code).otherwise(none)

    levels = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    cells = _let(own, lambda subsets: F.array_join(F.transform(levels, lambda j: F.array_join(F.transform(subsets, lambda terms, i: cell(terms, i, j)), "")), ""))
    head = F.concat(F.lpad(F.hex(F.col(level)), 2, "0"), F.lpad(F.hex(F.xxhash64(F.col(kept))), _WHOLE, "0"))
    return df.withColumn(out_col, F.concat(head, F.rtrim(cells, F.lit("0")))).drop(kept, level)


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets with a term of either document whose hashes agree, at the coarser of the
    two levels; 1 for equal fingerprints.  Where one document has so many more terms that no subset
    of its level holds a term of the other, nothing agrees."""
    la, lb = (F.conv(F.substring(x, 1, 2), 16, 10).cast("int") for x in (a, b))
    top = F.greatest(la, lb)
    width = _CELL * SUBSETS
    sa, sb = (F.rpad(F.substr(x, F.lit(3 + _WHOLE) + (top - lx) * width, F.lit(width)), width, "0") for x, lx in ((a, la), (b, lb)))
    none = "0" * _CELL
    cell = lambda s, i: F.substr(s, i * _CELL + 1, F.lit(_CELL))
    places = F.sequence(F.lit(0), F.lit(SUBSETS - 1))

    def share(p: Column) -> Column:
        x, y = p.getField("x"), p.getField("y")
        both = F.filter(places, lambda i: (cell(x, i) == cell(y, i)) & (cell(x, i) != none))
        either = F.filter(places, lambda i: (cell(x, i) != none) | (cell(y, i) != none))
        return F.coalesce(F.size(both) / F.nullif(F.size(either), F.lit(0)), F.lit(0.0))

    return F.when(a == b, F.lit(1.0)).otherwise(_let(F.struct(sa.alias("x"), sb.alias("y")), share))


def _place(cuts: list[int], value: Column) -> Column:
    """How many of the ascending ``cuts`` are no larger, by halving."""
    if not cuts:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    padded = _constant(cuts + [(1 << 63) - 1] * (2 * steps[0] - 1 - len(cuts)), "bigint")
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: at + F.when(F.element_at(padded, at + step) <= value, step).otherwise(F.lit(0)))
    return F.least(found, F.lit(len(cuts)))  # a value as large as the padding counts no padding


def with_next(docs: DataFrame, carried: list[str], key: str, n_buckets: int, cuts: list[int]) -> DataFrame:
    """Adds ``next_<c>`` of the row that follows in ascending ``key`` (after the last: the first).

    Rows are dealt into key ranges and each range's first row is also sent to the range before,
    so one shuffle of the rows serves and no task orders the whole table.
    """
    bucket = _place(cuts, F.col(key))
    ranged = docs.withColumn("__b", bucket)
    firsts = {r["__b"]: r["k"] for r in docs.select(key).withColumn("__b", bucket).groupBy("__b").agg(F.min(key).alias("k")).collect()}
    order = sorted(firsts)
    before = {b: (order[i - 1], 1 if i else 2) for i, b in enumerate(order)}
    size = (max(order) if order else 0) + 1
    first = F.element_at(_constant([firsts.get(b, 0) for b in range(size)], "bigint"), F.col("__b") + 1)
    to = F.element_at(_constant([before.get(b, (0, 0))[0] for b in range(size)], "int"), F.col("__b") + 1)
    rank = F.element_at(_constant([before.get(b, (0, 0))[1] for b in range(size)], "int"), F.col("__b") + 1)
    own = F.array(F.struct(F.col("__b").alias("b"), F.lit(0).alias("guest")))
    both = F.concat(own, F.array(F.struct(to.alias("b"), rank.alias("guest"))))
    placed = ranged.withColumn("__at", F.explode(F.when(F.col(key) == first, both).otherwise(own))).withColumns({"__p": F.col("__at.b"), "__guest": F.col("__at.guest")}).drop("__at", "__b")
    w = Window.partitionBy("__p").orderBy("__guest", key, *[F.xxhash64(c) for c in carried])
    return placed.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried}).where("__guest = 0").drop("__p", "__guest")


def fingerprint_documents(docs: DataFrame, band=BAND, chars_per_range: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The edited text has the last floor(n/2) code points replaced by the first as many (or all) of
    the next document by ascending id; a null id counts as the smallest, rows of one id follow by
    hash of their text.  Null text is empty.  An only document follows itself; an empty table
    gives no rows; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("__key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    stats = base.agg(F.count("*").alias("n"), F.sum(F.length("__text")).alias("chars")).first()
    ranges = min(RANGES, max(1, -(-(stats.chars or 0) // chars_per_range)))
    cuts = base.agg(F.percentile_approx("__key", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("c")).first().c if ranges > 1 else []
    cuts = sorted(set(cuts or []))
    words = lexicon(base, "__text", stats.n, band)
    marked = with_fingerprint(base, "__text", "fingerprint", words)
    paired = with_next(marked, ["__text", "fingerprint"], "__key", ranges, cuts)
    half = F.floor(F.length("__text") / 2).cast("int")
    edited = F.concat(F.substr("__text", F.lit(1), F.length("__text") - half), F.substr("next___text", F.lit(1), half))
    made = paired.select("doc_id", F.length("__text").cast("long").alias("n_chars"), edited.alias("__edited"), "fingerprint", F.col("next_fingerprint").alias("__next"))
    made = with_fingerprint(made, "__edited", "edited_fingerprint", words)
    return made.select("doc_id", "n_chars", F.sha2("__edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("__next")).alias("near_next"))

"""Source divergence audit: how far the sources of a language are apart, and by which terms.

A term is a run of ASCII letters and non-ASCII characters. One ``bytes.translate`` lowers A-Z and turns
every other ASCII byte into a space, ``bytes.split`` cuts the terms, and a ``Counter`` per document
gives their frequencies. Each task adds its documents up per (lang, source, term) before anything is
shuffled, so a hot source or a common term sends one row per task. Terms found in at least
``MIN_DOCS`` documents of a language are kept.

A term's share in a group is ``1 + floor(10^9 (count + 5) / (N + 5 V))``, in decimals, so no digit is
lost at any size. Two sources differ by the sum of the absolute differences of their shares over all
kept terms. Rows (term, source, share) are dealt by language, block of sources and a hash of the term
into units of about ``UNIT_ROWS`` rows; a unit fills a matrix of terms and sources (an absent source
has the share of count 0) and adds the differences up, so no pair is ever emitted per term. What is
not bounded by that is the result itself: all pairs of sources of a language.

Cases: null text, language and source are ''. A group without terms takes part with count 0; a language
without kept terms differs by 0. Repeated rows are documents of their own. Ties are ranked by the
bytes of the item. An empty table gives no rows. A very long text is held once as terms in its task.
Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equipoise.llm.common import stored, text_or_empty
from equipoise.llm.encoding import slices

# Fixed values of the audit.
MIN_DOCS, SCALE, PRIOR, TOP_TERMS = 30, 1_000_000_000, 5, 50

FLUSH = 200_000  # distinct (lang, source, term) a task holds before it passes them on
UNIT_ROWS = 200_000
SOURCE_BLOCK = 256
MATRIX_CELLS = 1 << 20

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
#: Lowers A-Z, keeps a-z and what is not ASCII, and blanks the rest.
TABLE = bytes(b if b > 127 else ord(chr(b).lower()) if b in _LETTERS else 32 for b in range(256))


def terms_of(data: bytes) -> Counter:
    """Frequencies of the terms of one text in UTF-8."""
    return Counter(data.translate(TABLE).split())


def _counted_rows(groups: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
    langs, sources, terms, n, df = [], [], [], [], []
    for (lang, source), (counts, docs) in groups.items():
        langs += [lang] * len(counts)
        sources += [source] * len(counts)
        terms += counts.keys()
        n += counts.values()
        df += [docs[t] for t in counts]
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()), pa.array(n, pa.int64()), pa.array(df, pa.int64())],
        ["lang", "source", "term", "n", "df"],
    )


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, df)`` of every task's documents: occurrences, and documents that
    hold the term. Tasks may give a key more than once; sums are right."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for big in batches:
            for batch in slices(big, 0):
                texts = batch.column(0).cast(pa.large_binary()).to_pylist()
                for text, lang, source in zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    counts, frequency = groups.setdefault((lang, source), (Counter(), Counter()))
                    before = len(counts)
                    found = terms_of(text)
                    counts.update(found)
                    frequency.update(found.keys())
                    held += len(counts) - before
                if held >= FLUSH:
                    yield _counted_rows(groups)
                    groups, held = {}, 0
        if held:
            yield _counted_rows(groups)

    rows = docs.select(text_or_empty().alias("text"), text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"))
    found = rows.mapInArrow(count, "lang string, source string, term binary, n bigint, df bigint")
    return found.withColumn("term", F.col("term").cast("string"))


def kept_terms(counted: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(lang, term, n, held)``: terms of enough documents; ``held`` lists ``(source, n)``."""
    # One shuffle serves both groupings: what is dealt by (lang, term) is dealt by its sources too.
    dealt = counted.repartition("lang", "term")
    per_source = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    held = F.collect_list(F.struct("source", "n"))  # at most the sources of a language
    terms = per_source.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"), held.alias("held"))
    return terms.where(F.col("df") >= min_docs).drop("df")


def _share(count: Column, total: Column) -> Column:
    """``1 + floor(SCALE (count + PRIOR) / total)`` without loss of digits."""
    top = (count + PRIOR).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.expr("1L") + F.call_function("div", top, total)


def group_table(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``(lang, source, at, size, total, lang_total)`` of every group: its number within the
    language, the language's number of sources, and the denominators of the shares."""
    groups = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source")).distinct()
    sums = kept.select("lang", F.explode("held").alias("h")).groupBy("lang", F.col("h.source").alias("source")).agg(F.sum("h.n").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n"))
    whole = Window.partitionBy("lang")
    smoothed = lambda n: (F.coalesce(F.col(n), F.lit(0)) + PRIOR * F.coalesce("v", F.lit(0))).cast("decimal(19,0)")
    return groups.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").select(
        "lang",
        "source",
        (F.row_number().over(whole.orderBy("source")) - 1).alias("at"),
        F.count("*").over(whole).cast("int").alias("size"),
        smoothed("n").alias("total"),
        smoothed("lang_n").alias("lang_total"),
    )


def scored_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, at, size, term, p, q)`` of every kept term in the groups that hold it."""
    rows = kept.select("lang", "term", F.col("n").alias("lang_n"), F.explode("held").alias("h"))
    rows = rows.select("lang", "term", "lang_n", F.col("h.source").alias("source"), F.col("h.n").alias("n"))
    joined = rows.join(groups, ["lang", "source"])  # Spark broadcasts the groups if they are few
    p, q = _share(F.col("n"), F.col("total")), _share(F.col("lang_n"), F.col("lang_total"))
    return joined.select("lang", "source", "at", "size", "term", p.alias("p"), q.alias("q"))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    return rows.withColumn("rank", F.row_number().over(order))


def group_terms(scored: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """Terms that a group uses more than its language, the ``top`` of each group: tasks keep their
    own top before the shuffle."""
    over = scored.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(over).where(F.col("rank") <= top)


def _differences(unit: pa.Table) -> pa.Table:
    """Summed differences between the sources of one block and all later ones over a unit's terms."""
    block = unit["block"][0].as_py()
    absent = pc.is_null(unit["term"]).combine_chunks().to_numpy(zero_copy_only=False)
    at, p = unit["at"].to_numpy(), unit["p"].to_numpy()
    size = int(absent.sum())
    zero = np.zeros(size, np.int64)
    zero[at[absent]] = p[absent]
    codes = unit["term"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)[~absent].astype(np.int64)
    at, p = at[~absent], p[~absent]
    order = np.argsort(codes, kind="stable")
    codes, at, p = codes[order], at[order], p[order]
    terms = int(codes[-1]) + 1 if len(codes) else 0
    mine = np.arange(block * SOURCE_BLOCK, min(size, (block + 1) * SOURCE_BLOCK))
    sums = np.zeros((len(mine), size), np.int64)
    step = max(1, MATRIX_CELLS // size)
    for low in range(0, terms, step):
        a, b = np.searchsorted(codes, (low, low + step))
        matrix = np.tile(zero, (min(step, terms - low), 1))
        matrix[codes[a:b] - low, at[a:b]] = p[a:b]
        for row, i in enumerate(mine):
            sums[row, i + 1 :] += np.abs(matrix[:, i + 1 :] - matrix[:, i, None]).sum(axis=0)
    left, right = np.nonzero(np.arange(size)[None, :] > mine[:, None])
    lang = pa.array([unit["lang"][0].as_py()] * len(left), pa.string())
    return pa.table({"lang": lang, "a": pa.array(mine[left], pa.int32()), "b": pa.array(right, pa.int32()), "value": sums[left, right]})


def source_pairs(scored: DataFrame, groups: DataFrame, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of all pairs of sources of a language."""
    units = max(1, -(-scored.count() // unit_rows))
    salt = F.pmod(F.xxhash64("term"), F.lit(units)).cast("int")
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / SOURCE_BLOCK).cast("int"))).alias("block")
    rows = scored.select("lang", blocks, salt.alias("salt"), "term", "at", "p")
    # Every unit also gets each source's share of count 0, in rows without a term.
    salts = F.explode(F.sequence(F.lit(0), F.lit(units - 1))).alias("salt")
    nothing = F.when(F.col("total") > 0, _share(F.lit(0).cast("bigint"), F.col("total"))).otherwise(F.expr("1L"))
    heads = groups.select("lang", "size", "at", nothing.alias("p"), salts).select("lang", blocks, "salt", F.lit(None).cast("string").alias("term"), "at", "p")
    parts = rows.unionByName(heads).groupBy("lang", "block", "salt").applyInArrow(_differences, "lang string, a int, b int, value bigint")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = sums.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("w"), "value")
    name = lambda at, to: groups.select("lang", F.col("at").alias(at), F.col("source").alias(to))
    named = ways.select("lang", "w.a", "w.b", "value").join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    return _ranked(named.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))


def source_audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """The report over ``docs (text, lang, source)``: ``lang, source, part, item, value, rank``."""
    kept = stored(kept_terms(term_counts(docs), min_docs), "terms")
    groups = stored(group_table(docs, kept), "groups")
    scored = stored(scored_terms(kept, groups), "scored")
    return source_pairs(scored, groups, unit_rows).unionByName(group_terms(scored, top))


SQL = rf"""
    WITH docs AS (
        SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
        FROM documents),
    terms AS (
        SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
    kept AS (
        SELECT lang, term, count(*) AS lang_n FROM terms GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
    sizes AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
    counts AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY lang, source, term),
    groups AS (
        SELECT lang, source, coalesce(any_value(total), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs)
        LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source) USING (lang, source)
        GROUP BY lang, source),
    grid AS (
        SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
               1 + CAST(({SCALE}::HUGEINT * (coalesce(n, 0) + {PRIOR})) // (total + {PRIOR} * v) AS BIGINT) AS p,
               1 + CAST(({SCALE}::HUGEINT * (lang_n + {PRIOR})) // (lang_total + {PRIOR} * v) AS BIGINT) AS q
        FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN counts c USING (lang, source, term)),
    pairs AS (
        SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN grid x ON x.lang = a.lang AND x.source = a.source
        LEFT JOIN grid y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
        GROUP BY a.lang, a.source, b.source),
    items AS (
        SELECT lang, source, 'pair' AS part, item, value FROM pairs
        UNION ALL SELECT lang, source, 'term', term, p - q FROM grid WHERE n > 0 AND p > q),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM items)
    SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""

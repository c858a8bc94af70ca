"""Source divergence audit: how far the word use of every source lies from that of others of its language.

A text becomes terms by one ``bytes.translate`` (letters lowered, separators blanked) and ``bytes.split``; a
Counter per document gives its frequencies, and a task adds up the documents of a (language, source) group in
bounded maps before anything is shuffled. All arithmetic after that is exact integers over the sparse counts:

* a term that a group lacks has the group's base share, so a pair's sum over all kept terms is the sum of two
  bases, plus what each side's own terms change, plus a correction for terms both have;
* a side's own terms change the sum only by their share, so they enter as a histogram of shares;
* the correction is computed where a term's rows lie together, in numpy over shifted copies of the sorted rows.

Nothing is made for a term that neither side of a pair has.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursemetrics.llm.common import blocks_of, stored, translate_table

#: Fixed value: shares are counted in parts of this.
PARTS = 1_000_000_000
LETTERS = translate_table(lambda b: b >= 128 or 65 <= b <= 90 or 97 <= b <= 122)
ENTRIES = 200_000      # counts a task holds before it passes them on
PAIR_ROWS = 100_000    # rows of whole terms that are paired at once


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents, added up within tasks only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, seen) in held.items():
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(n)), pa.array([source] * len(n)), pa.array(list(n), pa.binary()).cast(pa.string()),
                         pa.array(list(n.values()), pa.int64()), pa.array([seen[x] for x in n], pa.int64())],
                        names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for text, lang, source in zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found: Counter = Counter()
                for block in blocks_of((text.as_py() or b"").translate(LETTERS)):
                    found.update(block.split())
                n, seen = held.setdefault((lang or "", source or ""), (Counter(), Counter()))
                size -= len(n)
                n.update(found)
                seen.update(found.keys())
                size += len(n)
                if size >= ENTRIES:
                    yield from passed_on()
                    size = 0
        yield from passed_on()

    return docs.select(text_col, lang_col, source_col).mapInArrow(
        run, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column) -> Column:
    """``1 + floor(PARTS * (count + 1) / total)``; decimals, since the product passes 64 bits on large corpora."""
    top = (count + 1).cast("decimal(20,0)") * F.lit(PARTS).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, total.cast("decimal(20,0)"))


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The same on arrays: squares of shares stay under 2**63."""
    return (p - q) ** 2 // q


def common_terms(entries: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: for pairs with common terms, what those change against either side alone.

    ``entries`` is ``(lang, term, source, p, base)``. Rows are dealt by term and sorted, so that a task reads each
    term's rows one after the other and holds a block of whole terms at a time.
    """
    def correct(lang: np.ndarray, term: np.ndarray, code: np.ndarray, p: np.ndarray, base: np.ndarray, width: int):
        """Unordered pairs of rows of a term at distance 1, 2, ... in the sorted rows; both directions of each."""
        keys, values = [], []
        left = np.arange(len(term))
        step = 0
        while True:
            step += 1
            left = left[left + step < len(term)]
            left = left[term[left] == term[left + step]]
            if not len(left):
                break
            for a, b in ((left, left + step), (left + step, left)):
                values.append(gaps(p[a], p[b]) - gaps(p[a], base[b]) - gaps(base[a], p[b]) + gaps(base[a], base[b]))
                keys.append((lang[a] * width + code[a]) * width + code[b])
            if sum(map(len, keys)) > 1 << 22:
                keys, values = ([x] for x in summed(np.concatenate(keys), np.concatenate(values)))
        return summed(np.concatenate(keys), np.concatenate(values)) if keys else None

    def summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return key[first], np.add.reduceat(value, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def paired(table: pa.Table, last: bool):
            """(rows of the pairs of all terms known to be whole, the rest)."""
            table = table.combine_chunks()
            langs, terms, sources = (table.column(x).combine_chunks().dictionary_encode() for x in ("lang", "term", "source"))
            if isinstance(langs, pa.ChunkedArray):
                langs, terms, sources = (x.combine_chunks() for x in (langs, terms, sources))
            lang, term, code = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (langs, terms, sources))
            group = np.r_[0, np.cumsum((lang[1:] != lang[:-1]) | (term[1:] != term[:-1]))] if len(lang) else lang
            end = len(lang) if last else int(np.searchsorted(group, group[-1]))
            p, base = (table.column(x).to_numpy() for x in ("p", "base"))
            width = len(sources.dictionary)
            found = correct(lang[:end], group[:end], code[:end], p[:end], base[:end], width)
            rest = table.slice(end)
            if found is None:
                return None, rest
            key, value = found
            pair, item = key // width, key % width
            return pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(pair // width)), sources.dictionary.take(pa.array(pair % width)),
                 sources.dictionary.take(pa.array(item)), pa.array(value)], names=["lang", "source", "item", "value"]), rest

        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size >= PAIR_ROWS:
                out, rest = paired(pa.concat_tables(held), last=False)
                held, size = [rest], 0  # a term longer than a block is read on until it ends
                if out is not None:
                    yield out
        if held:
            out, _ = paired(pa.concat_tables(held), last=True)
            if out is not None:
                yield out

    dealt = entries.select("lang", "term", "source", "p", "base").repartition("lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(run, "lang string, source string, item string, value long")


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source") -> DataFrame:
    """Divergence of every (language, source) group: from each other source of the language, and its own terms.

    Terms are runs of A-Z, a-z (lowered) and characters beyond ASCII; a language keeps those in at least
    ``min_docs`` of its documents. With ``count`` a term's occurrences in a group, ``N`` their sum over the
    ``V`` kept terms, the share is ``p = 1 + floor(10**9 * (count + 1) / (N + V))``, and
    ``f = floor((p - q)**2 / q)``.

    Returns lang, source, part, item, value, rank. Part ``pair``: item is each other source of the language, q its
    share, value f summed over all kept terms (0 where none is kept). Part ``term``: item is each kept term that the
    group has, with a share above the language's q; the ``top`` of them. Rank runs from 1 by falling value, then
    item by its bytes.

    Null text, lang and source read as ''. Empty texts add no term, but their group is there; repeated rows count
    again; an empty table gives no rows; other columns are not read. A long text is split in blocks.
    """
    groups = docs.select(F.coalesce(lang_col, F.lit("")).alias("lang"), F.coalesce(source_col, F.lit("")).alias("source")).distinct()
    term = Window.partitionBy("lang", "term")
    counted = (term_counts(docs, text_col, lang_col, source_col).repartition("lang", "term")
               .groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = stored(counted.withColumns({"lang_n": F.sum("n").over(term), "lang_docs": F.sum("docs").over(term),
                                       "place": F.row_number().over(term.orderBy("source"))})
                  .where(F.col("lang_docs") >= min_docs).drop("docs", "lang_docs"), "divergence-terms")
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_if(F.col("place") == 1).alias("v"))
    known = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    total = F.coalesce("n", F.lit(0)) + F.col("v")
    known = stored(known.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), total.alias("total"), (F.col("lang_n") + F.col("v")).alias("lang_total"),
                                share(F.lit(0), total).alias("base")), "divergence-groups")

    entries = kept.join(known, ["lang", "source"]).select(
        "lang", "source", "term", "base", share(F.col("n"), F.col("total")).alias("p"), share(F.col("lang_n"), F.col("lang_total")).alias("q"))
    terms = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                          gap(F.col("p"), F.col("q")).alias("value"))

    other = known.select("lang", F.col("source").alias("item"), F.col("base").alias("item_base"))
    # Languages without a kept term have no shares: their pairs are 0.
    bases = known.join(other, "lang").where("source <> item").select(
        "lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * gap(F.col("base"), F.col("item_base"))).otherwise(F.lit(0)).alias("value"))
    shares = entries.groupBy("lang", "source", "base", "p").agg(F.count("*").alias("n"))
    p, base, item_base = F.col("p"), F.col("base"), F.col("item_base")
    alone = (shares.join(other, "lang").where("source <> item").select("lang", F.inline(F.array(
        F.struct(F.col("source"), F.col("item"), (F.col("n") * (gap(p, item_base) - gap(base, item_base))).alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("n") * (gap(item_base, p) - gap(item_base, base))).alias("value"))))))
    pairs = (bases.unionByName(alone).unionByName(common_terms(entries)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value"))

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    best = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)


#: The same result in DuckDB.
SQL = r"""
WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r FROM documents),
t AS (SELECT lang, source, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
l AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n AS lang_n
      FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM x GROUP BY ALL),
p AS (SELECT x.lang, x.source, x.term, x.n, 1 + (1000000000 * (x.n + 1)) // (s.total + l.v) AS p, 1 + (1000000000 * (x.lang_n + 1)) // (l.n + l.v) AS q
      FROM x JOIN s USING (lang, source) JOIN l ON l.lang = x.lang),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(v.value), 0)::BIGINT AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
                    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) v
         ON v.lang = a.lang AND v.source = a.source AND v.item = b.source GROUP BY ALL),
term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) QUALIFY part = 'pair' OR rank <= 200
"""

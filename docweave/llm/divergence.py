"""Divergence of sources: how the terms of each source of a language differ from those of the others and of the whole.

First pass: the exact number of documents with each term; those in enough documents are the language's vocabulary. Second pass: an Aho-Corasick automaton
over the kept terms, each with a delimiter on both sides, counts their occurrences in the texts, in which every stretch of other characters is one
delimiter. The vocabulary goes to the tasks in pieces of bounded size, each with a scan of its own; a task holds one piece at a time. The counts, one row for each group and
term that occurs there, are dealt into blocks of terms; a block gets the groups of its language and adds up the differences of every pair of groups over its terms, so a pair
is a row per block and never a row per term.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions.session import spool

#: What the bytes of a text become: A-Z small letters, all other ASCII but small letters spaces, the rest as it is. So terms stand between spaces.
SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of terms in a piece of the vocabulary (a longer term is a piece of its own), entries that a task holds before it sends them on.
PIECE_BYTES, HELD = 4 << 20, 200_000
#: Counts in a block of terms, and numbers in a matrix of groups and terms.
BLOCK_COUNTS, MATRIX = 100_000, 2_000_000
#: Shares are whole numbers of this part, with this much added to every count.
UNIT, ADDED = 1_000_000_000, 5


def rows_of(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, text) with nulls as empty texts."""
    own = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    return docs.select(own(lang_col, "lang"), own(source_col, "source"), own(text_col, "text"))


def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[str, str, bytes]]:
    """lang, source and spaced text of each row."""
    for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
        yield lang, source, text.as_buffer().to_pybytes().translate(SPACED)


def vocabulary(rows: DataFrame, least: int) -> DataFrame:
    """(lang, term, documents) of the terms in at least `least` rows of the language. Documents are counted within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def table() -> Iterator[pa.RecordBatch]:
            for lang, own in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.keys(), pa.binary()).cast(pa.string()), pa.array(own.values(), pa.int64())], names=["lang", "term", "n"])
            found.clear()

        for b in batches:
            for lang, _, text in texts_of(b):
                found.setdefault(lang, Counter()).update(set(text.split()))
                if len(found[lang]) > HELD:
                    yield from table()
        yield from table()

    terms = rows.mapInArrow(run, "lang string, term string, n long")
    return terms.groupBy("lang", "term").agg(F.sum("n").alias("documents")).where(F.col("documents") >= least)


def pieces_of(kept: DataFrame, piece_bytes: int) -> tuple[DataFrame, int]:
    """`kept` with its piece, and the number of pieces; a piece has at most `piece_bytes` of terms, or one term."""
    size = F.octet_length("term") + F.octet_length("lang") + 2
    n = math.ceil((kept.agg(F.sum(size)).first()[0] or 0) * 1.1 / piece_bytes)
    while n:
        dealt = kept.withColumn("piece", F.pmod(F.xxhash64("lang", "term"), F.lit(n)).cast("int"))
        if dealt.groupBy("piece").agg(F.sum(size).alias("bytes"), F.count("*").alias("terms")).where((F.col("bytes") > piece_bytes) & (F.col("terms") > 1)).isEmpty():
            return dealt, n
        n *= 2
    return kept.withColumn("piece", F.lit(0)), 0


#: The automata of the piece that this task's process has built last, by language.
BUILT: dict = {}


def automaton(piece: str, terms: dict[str, list[str]], lang: str):
    """The automaton of a language's terms in the piece, None without one; the values are places in the list of terms."""
    import ahocorasick

    if BUILT.get("piece") != piece:
        BUILT.clear()
        BUILT["piece"] = piece
    if lang not in BUILT:
        a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate(terms.get(lang, [])):
            a.add_word(f" {t} ", i)
        if len(a):
            a.make_automaton()
        BUILT[lang] = a if len(a) else None
    return BUILT[lang]


def counted(rows: DataFrame, dealt: DataFrame, number: int) -> DataFrame:
    """(lang, source, term, n): occurrences of the terms of a piece, added up within each task."""
    terms: dict[str, list[str]] = {}
    for r in dealt.where(F.col("piece") == number).select("lang", "term").collect():
        terms.setdefault(r.lang, []).append(r.term)
    shared = rows.sparkSession.sparkContext.broadcast(terms)
    name = f"{rows.sparkSession.sparkContext.applicationId}-{shared._jbroadcast.id()}"
    shared._value = None  # the driver keeps no piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], Counter] = {}
        held = 0

        def table() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in found.items():
                term = [shared.value[lang][i] for i in own]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array([source] * len(own), pa.string()), pa.array(term, pa.string()), pa.array(own.values(), pa.int64())], names=["lang", "source", "term", "n"])
            found.clear()

        for b in batches:
            for lang, source, text in texts_of(b):
                a = automaton(name, shared.value, lang)
                if a is not None:
                    own = found.setdefault((lang, source), Counter())
                    before = len(own)
                    own.update(map(itemgetter(1), a.iter(f" {text.decode()} ")))
                    held += len(own) - before
                    if held > HELD:
                        yield from table()
                        held = 0
        yield from table()

    return rows.mapInArrow(run, "lang string, source string, term string, n long")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + ADDED) / (total + ADDED * terms)), exactly; null without terms."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (n + ADDED).cast("decimal(20,0)")
    return F.call_function("div", top, (total + ADDED * terms).cast("decimal(20,0)")) + 1


def differences(postings: pd.DataFrame, groups: pd.DataFrame, lang: str, block: int) -> pd.DataFrame:
    """(lang, source, item, value): for every two groups the differences of their shares, summed over the terms in the postings. groups: source and base, the share of a term that
    does not occur."""
    groups = groups.sort_values("source", kind="stable")
    names, base = groups["source"].to_numpy(), groups["base"].to_numpy(np.int64)
    place = pd.Index(names).get_indexer(postings["source"])
    term, terms = pd.factorize(postings["term"])
    order = np.argsort(term, kind="stable")
    place, term, p = place[order], term[order], postings["p"].to_numpy(np.int64)[order]
    total, width = np.zeros((len(names), len(names)), np.int64), max(1, MATRIX // max(1, len(names)))
    for first in range(0, len(terms), width):
        a, b = np.searchsorted(term, [first, first + width])
        shares = np.repeat(base[:, None], min(width, len(terms) - first), axis=1)
        shares[place[a:b], term[a:b] - first] = p[a:b]
        for i in range(len(names) - 1):
            total[i, i + 1 :] += np.abs(shares[i + 1 :] - shares[i]).sum(axis=1)
    x, y = np.nonzero(~np.eye(len(names), dtype=bool))
    return pd.DataFrame({"lang": lang, "source": names[x], "item": names[y], "value": (total + total.T)[x, y]})


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 30, top: int = 50, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): how each group, a source within a language, differs.

    Terms are stretches without ASCII characters other than letters, A-Z in lower case. A language keeps the terms in at least `least` of its documents. The share of a kept term
    is 1 + floor(1e9 * (n + 5) / (N + 5 * V)), with n its occurrences in the group or language, N those of all kept terms there, V the number of kept terms. Part `pair`: the item is each
    other source of the language, the value the sum of the differences of the shares of all kept terms. Part `term`: the item is each term that occurs in
    the group and has a greater share there than in the language, the value that difference, the `top` greatest only. Ranks count from 1 by falling value,
    ties by the item's bytes.

    Nulls count as empty texts, so a null and an empty source are one group. Groups without any kept term have pairs, too; without kept terms in the
    language all values are 0. Every row is a document, whatever its other columns; repeated rows count each. Texts and terms may have any length. A sum of differences must fit 64
    bits. An empty table gives no rows. The texts are scanned once for every `piece_bytes` of kept terms; an automaton takes about 15 bytes of memory for each byte of them.
    """
    rows = rows_of(docs, text_col, lang_col, source_col)
    kept = spool(vocabulary(rows, least), "vocabulary")
    dealt, n = pieces_of(kept, piece_bytes)
    counts = [counted(rows, dealt, i) for i in range(n)]
    empty = rows.sparkSession.createDataFrame([], "lang string, source string, term string, n long")
    found = spool(reduce(DataFrame.unionByName, counts, empty).groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "postings")

    sizes = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("postings"))
    words = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(words, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "postings", "terms")])
    whole = F.coalesce(F.sum("total").over(W.partitionBy("lang")), F.lit(0))
    blocks = F.ceil(F.sum("postings").over(W.partitionBy("lang")) / F.lit(BLOCK_COUNTS)).cast("int")
    groups = spool(groups.withColumns({"whole": whole, "blocks": blocks}), "groups")

    shared = found.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "whole", "terms", "blocks", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    bases = groups.where("terms > 0").select("lang", "source", share(F.lit(0).cast("long"), F.col("total"), F.col("terms")).alias("base"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    summed = shared.select("lang", "source", "term", "p", block).groupBy("lang", "block").cogroup(bases.groupBy("lang", "block")).applyInPandas(
        lambda key, x, y: differences(x, y, *key), "lang string, source string, item string, value long"
    )
    # one row per pair, as the result has
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(others, "lang").where("source <> item").join(summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    overall = found.groupBy("lang", "term").agg(F.sum("n").alias("all"))
    excess = F.col("p") - share(F.col("all"), F.col("whole"), F.col("terms"))
    terms = shared.join(overall, ["lang", "term"]).where("n > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess.alias("value")).where("value > 0")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: divergence of the sources of all `documents`."""
    from docweave.functions.session import spread, table

    return source_divergence(spread(table(spark, sf_dir, "documents").select("text", "lang", "source")))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS term FROM d),
v AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*)::BIGINT AS n FROM t JOIN v USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
k AS MATERIALIZED (SELECT lang, source, term, coalesce(n, 0)::BIGINT AS n FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
z AS (SELECT lang, source, sum(n)::BIGINT AS total, count(*)::BIGINT AS terms FROM k GROUP BY lang, source),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * terms) AS p FROM k JOIN z USING (lang, source)),
l AS (SELECT lang, term, sum(n) AS n FROM k GROUP BY lang, term),
m AS (SELECT lang, sum(n) AS total, count(*) AS terms FROM l GROUP BY lang),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * terms) AS q FROM l JOIN m USING (lang)),
s AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p))::BIGINT AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
a AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM a QUALIFY part = 'pair' OR rank <= 50
"""

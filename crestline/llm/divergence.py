"""How far the sources of a language differ in their words: exact distances of smoothed term distributions.

Every (lang, source) group, and every language, gives each kept term t of the language the integer
p(t) = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)); a pair of groups lies sum |p - q| over the V kept terms apart.
Most terms stand in few groups, so that most of a row is its group's *baseline* z, the p of a count of zero.

Distances are rows of a sparse product, by Gustavson's scheme: a group's row is walked once, each of its terms leads
through the term-major index to the groups that share it, and what the shared term adds is scattered into a dense
accumulator with one cell for each peer. No pair of postings is ever a row of a table. What is not shared is corrected:

    sum |p - q| = sum_g |p - z_h| + sum_h |q - z_g| + sum_shared (|p - q| - |p - z_h| - |q - z_g|)
                  + (V - n_g - n_h + n_shared) |z_g - z_h|

The first two sums come from sorted values and their running totals, one search for each peer. Groups are numbered within
a language and dealt in blocks of BLOCK; a task holds the rows of one block and the index of one, and where a block has
more than ENTRIES terms its terms are dealt over several parts, whose cells are added: the largest source is spread, and a
task is bounded. The result has a row for each ordered pair of sources, which is what is asked for.

Words are counted in Arrow tasks that add up a batch before anything is shuffled: a frequent word or a hot source is one
row for each task. Numbers are longs and decimals throughout.

Defined results: null text, lang and source are ''; repeated rows are documents of their own; a group without kept terms
has its pairs, with the baseline as its row; a language without kept terms has pairs of value 0 and no terms; a language
with one source has terms only; a text of any length is counted whole; ties of value go by the item's UTF-8 bytes; an
empty table gives no rows; other columns are not read, and doc_id is not needed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, texts_as_bytes

SCALE, PRIOR = 1_000_000_000, 5
#: Groups of a block; terms of a block's groups in one task; distinct words that a counting task holds before it passes them on.
BLOCK, ENTRIES, HELD = 128, 1 << 16, 400_000

#: Letters and all bytes of code points beyond ASCII stay, A-Z in lower case; all else parts words.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def words(text: bytes) -> list[bytes]:
    """The text's terms: runs of letters and of characters beyond ASCII."""
    return text.translate(_WORD).split()


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs of the task's documents; a row without term for each group."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [None, *(t.decode() for t in n)]
            values = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.string()), pa.array([0, *n.values()]), pa.array([0, *(docs[t] for t in n)])]
            for at in range(0, len(terms), 50_000):
                yield pa.RecordBatch.from_arrays([v.slice(at, 50_000) for v in values], schema=_COUNTS)
        held.clear()

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, texts_as_bytes(batch, "text"), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, found = len(n), Counter(words(text))
            n.update(found)
            docs.update(found.keys())
            size += len(n) - before
            if size > HELD:
                yield from rows()
                size = 0
    yield from rows()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents), and a row with a null term for each group."""
    clean = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    rows = clean.mapInArrow(_partial_counts, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str):
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exact."""
    return F.expr(f"1 + ((cast({count} as decimal(20,0)) + {PRIOR}) * cast({SCALE} as decimal(10,0))) div (cast({total} as decimal(20,0)) + {PRIOR} * cast({terms} as decimal(15,0)))")


class Side:
    """Groups of one block with their terms in one part: values by group and by term, baselines."""

    def __init__(self, rows: pd.DataFrame):
        base = rows[rows["term_id"] < 0].sort_values("g")
        terms = rows[rows["term_id"] >= 0].sort_values(["term_id", "g"])
        self.g, self.z = base["g"].to_numpy(), base["p"].to_numpy()
        self.of = np.searchsorted(self.g, terms["g"].to_numpy())
        self.term, self.p = terms["term_id"].to_numpy(), terms["p"].to_numpy()
        order = np.argsort(self.of, kind="stable")
        edges = np.searchsorted(self.of[order], np.arange(len(self.g) + 1))
        self.rows = [order[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        self.n = np.diff(edges)

    def from_baselines(self, z: np.ndarray) -> np.ndarray:
        """Of each group the sum of |p - z| over its terms, for each z: (groups, len(z))."""
        out = np.zeros((len(self.g), len(z)), dtype=np.int64)
        for k, own in enumerate(self.rows):
            p = np.sort(self.p[own])
            total = np.concatenate(([0], np.cumsum(p)))
            below = np.searchsorted(p, z)
            out[k] = z * below - total[below] + (total[-1] - total[below]) - z * (len(p) - below)
        return out


def accumulate(left: Side, right: Side) -> np.ndarray:
    """What this part's terms add to the distance of each group of left and of right, less V |z_g - z_h|."""
    gap = np.abs(left.z[:, None] - right.z[None, :])
    out = left.from_baselines(right.z) + right.from_baselines(left.z).T - (left.n[:, None] + right.n[None, :]) * gap
    for k, own in enumerate(left.rows):
        first, last = np.searchsorted(right.term, left.term[own], "left"), np.searchsorted(right.term, left.term[own], "right")
        many = last - first
        # the postings of all the row's terms, one after the other
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        p, q, peer = np.repeat(left.p[own], many), right.p[at], right.of[at]
        row = np.zeros(len(right.g), dtype=np.int64)
        np.add.at(row, peer, np.abs(p - q) - np.abs(p - right.z[peer]) - np.abs(q - left.z[k]) + gap[k][peer])
        out[k] += row
    return out


def _tile(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
    rows, index = Side(cell[cell["row"]]), Side(cell[~cell["row"]])
    found = accumulate(rows, index)
    g, h = np.meshgrid(rows.g, index.g, indexing="ij")
    out = pd.DataFrame({"lang": key[0], "g": g.ravel(), "h": h.ravel(), "value": found.ravel()})
    return out[out["g"] != out["h"]]


def distances(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """lang, source, item, value for each ordered pair of a language's groups.

    ``groups``: lang, source, g (numbers from 0 within a language), z, terms (V), last (block), parts. ``rows``: lang, g,
    term_id, p, last, parts.
    """
    block = (F.col("g") / BLOCK).cast("int")
    values = rows.withColumn("part", F.pmod(F.xxhash64("term_id"), "parts").cast("int"))
    # each group's baseline is there in every part, so that a part knows all its groups
    base = groups.select("lang", "g", F.lit(-1).cast("long").alias("term_id"), F.col("z").alias("p"), "last", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = values.select("lang", "g", "term_id", "p", "last", "part").unionByName(base)
    # a block's rows meet the index of every block, and its own index meets the rows of every block
    every, b = F.sequence(F.lit(0), F.col("last")), block
    tiles = F.concat(F.transform(every, lambda o: F.struct(b.alias("r"), o.alias("c"), F.lit(True).alias("row"))), F.transform(every, lambda o: F.struct(o.alias("r"), b.alias("c"), F.lit(False).alias("row"))))
    dealt = both.select("lang", "part", "g", "term_id", "p", F.explode(tiles).alias("tile")).select("lang", "part", "tile.r", "tile.c", "tile.row", "g", "term_id", "p")
    cells = dealt.groupBy("lang", "part", "r", "c").applyInPandas(_tile, "lang string, g long, h long, value long")
    cells = cells.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    own = groups.select("lang", "g", "source", "z", "terms")
    peer = groups.select("lang", F.col("g").alias("h"), F.col("source").alias("item"), F.col("z").alias("z_h"))
    return cells.join(own, ["lang", "g"]).join(peer, ["lang", "h"]).select("lang", "source", "item", F.when(F.col("terms") > 0, F.col("value") + F.col("terms") * F.abs(F.col("z") - F.col("z_h"))).otherwise(F.lit(0)).cast("long").alias("value"))


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: distances of each group from its peers, and the ``top``
    terms that it uses more than its language does. A term is kept if ``min_docs`` documents of its language have it."""
    counts = stored(term_counts(docs, text_col, lang_col, source_col), "divergence-counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= min_docs)
    kept = stored(kept.select("lang", "term", "n_lang", F.monotonically_increasing_id().alias("term_id")), "divergence-terms")
    entries = stored(counts.where("term is not null").join(kept, ["lang", "term"]).select("lang", "source", "term", "term_id", "n", "n_lang"), "divergence-entries")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("total_lang"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    # windows over groups only: a row for each source of a language, with what its entries need to know of the language
    groups = groups.withColumn("g", (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("long")).withColumn("block", (F.col("g") / BLOCK).cast("int"))
    groups = groups.withColumn("load", F.sum("own").over(W.partitionBy("lang", "block")))
    parts, z = F.ceil(F.greatest(F.max("load").over(W.partitionBy("lang")), F.lit(1)) / ENTRIES), F.when(F.col("terms") > 0, share("0", "total", "terms")).otherwise(F.lit(0).cast("long"))
    groups = stored(groups.select("lang", "source", "g", "terms", "total", "total_lang", z.alias("z"), parts.cast("int").alias("parts"), F.max("block").over(W.partitionBy("lang")).alias("last")), "divergence-groups")
    shared = entries.join(groups, ["lang", "source"]).select("lang", "source", "g", "term", "term_id", "last", "parts", share("n", "total", "terms").alias("p"), share("n_lang", "total_lang", "terms").alias("q"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = shared.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", rank).where(F.col("rank") <= top)
    pairs = distances(groups, shared.select("lang", "g", "term_id", "p", "last", "parts")).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank)
    return pairs.unionByName(terms)


ORACLE_SQL = """WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 30),
size AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * s.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 5)) // (s.total + 5 * s.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN size s USING (lang) LEFT JOIN total t USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
    FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pairs x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r QUALIFY part = 'pair' OR rank <= 50"""

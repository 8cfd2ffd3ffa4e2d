"""Names in texts against the pattern that defines them, and the compositions of the text functions."""

from __future__ import annotations

import random
import re
import unicodedata

from pyspark.sql import functions as F

from crestline.functions import predicates as P
from crestline.functions import text as T
from crestline.operators import names

ROSTER = [("a", "김철수", 0), ("a", "철수", 1), ("a", "Kim C. Soo", 2), ("b", "마리", 3), ("b", "마리아", 4), ("c", "★별", 5), ("c", "O'Neil", 6), ("d", "철수", 7), ("d", "", 8), ("d", None, 9), ("e", "ab", 10), ("e", "cd", 11)]


def plain(text, name):
    """One pattern for each name, over letters and numbers of Python's own classes."""
    text, name = unicodedata.normalize("NFC", text), unicodedata.normalize("NFC", name)
    ends = "|".join((*names.ENDINGS, names.CALLED[names.closed_syllable(name[-1])]))
    return bool(re.search(rf"(?:^|(?<=[\W_])){re.escape(name)}(?:{ends})?(?=$|[\W_])", text))


def test_mentions_equal_patterns(spark, monkeypatch):
    rnd = random.Random(2)
    parts = [n for _, n, _ in ROSTER if n] + [unicodedata.normalize("NFD", "김철수"), *names.ENDINGS, "야", "아", *[" "] * 12, ".", "x", "7", "_", "\n", "é"]
    texts = [(k, "".join(rnd.choices(parts, k=rnd.randint(0, 7)))) for k in range(1500)] + [(-1, None), (-2, ""), (-3, "마리 " * 200_000), (-3, "마리 " * 200_000)]
    want = {}
    for k, text in texts:
        for who in "abcde":
            own = sorted((n for p, n, _ in ROSTER if p == who and n), key=lambda n: -len(n))
            hit = next((n for n in own if text and plain(text, n)), None)
            if hit:
                want[k, who] = hit
    df = spark.createDataFrame(texts, "id long, text string").withColumn("name", F.lit("clash"))
    roster = spark.createDataFrame(ROSTER, "participant string, name string, place int")
    for most in (2_000_000, 6):  # one automaton, then several
        monkeypatch.setattr(names, "MOST_CHARS", most)
        assert {(r["id"], r["participant"]): r["name"] for r in names.name_mentions(df, roster).collect()} == want
    assert len(want) > 300 and {"마리아", "Kim C. Soo", "★별"} <= set(want.values())
    assert names.name_mentions(df, roster.limit(0)).collect() == []


def test_mention_counts(spark):
    chapters = spark.createDataFrame([("x", 1, "마리와 철수님"), ("x", 2, "마리."), ("y", 3, "마리가요")], "broadcast_id string, id int, text string")
    roster = spark.createDataFrame(ROSTER, "participant string, name string, place int")
    people = chapters.select("broadcast_id").distinct().join(roster.select("participant").distinct())
    got = {tuple(r) for r in names.mention_counts(names.name_mentions(chapters, roster), chapters, people).where("participant in ('b', 'd')").collect()}
    assert got == {("x", "b", 2, "transcript-mentions"), ("x", "d", 1, "transcript-mentions"), ("y", "b", 0, "catalog-only"), ("y", "d", 0, "catalog-only")}


def test_compositions(spark):
    rows = ["Ｌｉｖｅ　①ⅳ ﬁn\x00​al ", "한글 제목 [ｂＣ-_５６７８９０１] .ＭＰ４ ", "a.txt [short] ½", None, "", "né " * 3, "﻿ x 　y "]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string")
    got = df.select("k", T.clean_text(F.col("t"), 12).alias("clean"), T.norm_title(F.col("t")).alias("title"), T.terms(F.col("t")).alias("terms")).orderBy("k").collect()

    def clean(t):
        t = re.sub(r"\s+", " ", "".join(" " if unicodedata.category(c) in ("Cc", "Cf") else c for c in unicodedata.normalize("NFKC", t))).strip()
        return t[:12].strip()

    assert [r["clean"] for r in got] == [None if t is None else clean(t) for t in rows]
    assert [r["title"] for r in got[:4]] == ["live 1iv fin\x00​al", "한글 제목", "a txt short 1 2", None]
    assert got[0]["terms"] == ["live", "1iv", "fin", "al"] and got[5]["terms"] == ["né"]
    number = spark.createDataFrame([(unicodedata.normalize("NFD", "치지직") + " 1234567",), ("치지직 12345678901234",), ("https://chzzk.naver.com/video/7654321",)], "t string")
    assert [r[0] for r in number.select(P.replay_number(F.col("t"))).collect()] == ["1234567", None, "7654321"]

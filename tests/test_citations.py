"""Sentence citations against all pairs, with words that most sentences share."""

from __future__ import annotations

import random
import re

from crestline.operators import transcript


def terms(text):
    return {w for w in re.split(r"[\W_]+", (text or "").lower()) if len(w) >= 2}


def test_citations_equal_all_pairs_with_few_of_them(spark):
    rnd = random.Random(6)
    rare, common = [f"w{k:03}" + "x" * (k % 9) for k in range(300)], ["the", "and", "of"]
    some = lambda n: " ".join(rnd.choices(rare, k=n) + rnd.choices(common, k=3))
    texts = [("a" if k % 3 else "b", k, ". ".join(some(rnd.randint(0, 6)) for _ in range(rnd.randint(0, 4)))) for k in range(250)]
    queries = [(rnd.choice("ab"), k, rnd.choice(([some(rnd.randint(0, 8))] * 5) + ["the of", "", None])) for k in range(120)]
    df, q = spark.createDataFrame(texts, "broadcast_id string, text_id int, text string"), spark.createDataFrame(queries, "broadcast_id string, id int, text string")
    sentences = [(b, t, s, terms(x)) for b, t, text in texts for s, x in enumerate(re.findall(r"[^.!?\n]+[.!?]*", text))]
    want, sharing = {}, 0
    for b, k, text in queries:
        found = [(-sum(min(8, len(w)) for w in terms(text) & own), t, s) for b2, t, s, own in sentences if b2 == b]
        sharing += sum(f[0] < 0 for f in found)
        if found and min(found)[0] <= -2:
            want[b, k] = min(found)
    got = {(r["broadcast_id"], r["id"]): (-r["score"], r["text_id"], r["s"]) for r in transcript.cite_sentences(q, df).collect()}
    assert got == want and len(want) > 60
    made = transcript.sentence_candidates(q, df).count()
    assert made < sharing / 2, (made, sharing)
    assert transcript.cite_sentences(q.limit(0), df).collect() == [] == transcript.cite_sentences(q, df.limit(0)).collect()

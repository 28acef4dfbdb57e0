import random
import re
from collections import Counter, defaultdict

import pytest
from conftest_llm import documents

from pagewright.llm import divergence


def brute(rows, least=10, top=10):
    """rows are (doc_id, text, lang, source)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        groups = {s: Counter({t: c[t] for t in kept}) for (x, s), c in counts.items() if x == lang}
        whole = Counter()
        for c in groups.values():
            whole.update(c)

        def shares(c, kept=kept):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, i.decode(), -v, r) for r, (v, i) in enumerate(items, 1)]
    return sorted(out)


def result(docs, **more):
    return sorted(map(tuple, divergence.audit(docs, **more).select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.mark.parametrize(("held", "pairs"), [(1, 3), (300_000, 2_000_000)])
def test_audit(spark, monkeypatch, held, pairs):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "PAIRS", pairs)
    draw = random.Random(11)
    words = ["alpha", "BETA", "gamma", "été", "ÀB", "日本", "x-y", "it's", "z9z", "\x85mid\xa0", "tab\tnew\nline", "a\x00b"]
    rows = [(i, " ".join(draw.choices(words, k=draw.randint(0, 30))), draw.choice(["en", "en", "de", "", None]), draw.choice(["s1", "s1", "s1", "s2", "s3", "ü", "", None])) for i in range(160)]
    rows += [(900, None, "en", "silent"), (901, "rare words only", "xx", "s1"), (902, "", "xx", "s2"), (903, "alone", "yy", "one")] + [(None, "alpha alpha beta", "en", "s4")] * 6
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = result(docs, least=4)
    assert got == brute(rows, least=4)
    assert {r[:4] for r in got if r[0] == "xx"} == {("xx", "s1", "pair", "s2"), ("xx", "s2", "pair", "s1")} and not [r for r in got if r[0] == "yy"]


def test_awkward_rows(spark, awkward):
    rows = [(d, t, "en", s) for d, t, s in awkward]
    assert result(documents(spark, awkward), least=1) == brute(rows, least=1)
    assert result(documents(spark, awkward)) == brute(rows)
    assert result(documents(spark, [])) == []


def test_every_term_is_in_a_cell(spark):
    """A pair's cells hold every kept term once; the zero cells are never rows of a join."""
    rows = [(i, " ".join(f"w{chr(97 + (i * k) % 26)}" for k in range(12)), "en", f"s{i % 4}") for i in range(60)]
    counts = divergence.counted(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    kept = divergence.frequent(counts, 5).cache()
    v = kept.count()
    pairs = spark.createDataFrame([("en", f"s{a}", f"s{b}", v) for a in range(4) for b in range(a + 1, 4)], "lang string, s string, t string, v long")
    cells = divergence.with_zeros(divergence.joint(kept), kept, pairs)
    assert {r["n"] for r in cells.groupBy("s", "t").agg({"m": "sum"}).withColumnRenamed("sum(m)", "n").collect()} == {v}
    assert cells.filter("m <= 0").count() == 0


def test_shares_are_exact(spark):
    from pyspark.sql import functions as F

    n = 2**62
    row = spark.range(1).select(divergence.share(F.lit(n - 2).cast("long"), F.lit(n).cast("long"), F.lit(7).cast("long")).alias("p")).first()
    assert row["p"] == 1 + 10**9 * n // (n + 14)

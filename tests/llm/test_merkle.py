import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from conftest_llm import documents
from pyspark.sql import functions as F

from pagewright.llm import merkle


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests, arity):
    """The root of some nodes and each one's siblings by level."""
    paths, at, layer = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(layer) > 1:
        for k, i in enumerate(at):
            run = layer[i // arity * arity : i // arity * arity + arity]
            paths[k].append(("".join(run[: i % arity]), "".join(run[i % arity + 1 :])))
        layer = [sha("".join(layer[i : i + arity])) for i in range(0, len(layer), arity)]
        at = [i // arity for i in at]
    return layer[0], paths


def brute(rows, arity):
    """rows are (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for d, s, g, n, t in rows:
        own = leaf(d, s, g, n, t)
        low = None if t is None else "".join(c.lower() if c.isascii() else c for c in t)
        hit = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        groups[g].append((d is not None, d or 0, own, d, leaf(d, s, g, n, low) if hit else own))
    names = sorted(groups, key=lambda g: b"" if g is None else b"=" + g.encode())
    made = {}
    for g in names:
        groups[g].sort(key=lambda m: m[:3])
        made[g] = tree([m[2] for m in groups[g]], arity)
    root, above = tree([made[g][0] for g in names], arity)
    out = []
    for g, top in zip(names, above, strict=True):
        for (_, _, own, d, shown), path in zip(groups[g], made[g][1], strict=True):
            folded = shown
            for lo, hi in path + top:
                folded = sha(lo + folded + hi)
            out.append((d, own, made[g][0], root, sha("".join(lo + hi for lo, hi in path + top)), folded, folded == root))
    return sorted(out, key=repr)


def result(docs, arity, levels):
    found = merkle.tampered_proofs(docs, arity, levels)
    proof, shown = F.col("proof"), F.col("shown")
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(proof).alias("p"), merkle.folded(shown, proof).alias("f"))
    return sorted(map(tuple, found.withColumn("ok", F.col("f") == F.col("root")).collect()), key=repr)


@pytest.mark.parametrize(("arity", "levels"), [(8, 3), (2, 1), (3, 2)])
def test_trees(spark, arity, levels):
    draw = random.Random(7)
    langs = [None, "", "en", "de", "é", "z"]
    rows = [(i, draw.choice(["a", None, ""]), draw.choice(langs), draw.choice([None, i]), draw.choice(["Text %d", "plain %d", "ÄB %d"]) % i) for i in range(150)] + [(500, "s", "lone", 1, None), (501, "s", "lonely", 1, "")]
    rows += [(7, "a", "en", 7, "Same")] * 3 + [(None, None, "de", None, "Upper")] * 2 + [(7, "a", "en", 8, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    got = result(docs, arity, levels)
    assert got == brute(rows, arity)
    assert any(not r[-1] for r in got) and len({r[3] for r in got}) == 1


def test_awkward_rows_and_small_tables(spark, awkward):
    def full(rows):
        return [(d, s, "en", None, t) for d, t, s in rows]

    assert result(documents(spark, awkward), 8, 3) == brute(full(awkward), 8)  # one language: the root is its tree's
    assert result(documents(spark, awkward[:1]), 8, 3) == brute(full(awkward[:1]), 8)
    assert result(documents(spark, []), 8, 3) == []


def test_frontiers_in_any_order():
    """Events of a block in any order and split over any tasks give one top."""
    draw = random.Random(2)
    for n in (1, 2, 9, 27, 70, 81):
        nodes = [sha(str(i)) for i in range(n)]
        for block in range(-(-n // 27)):
            own = list(range(block * 27, min(n, block * 27 + 27)))
            want, layer, size = None, [nodes[i] for i in own], n
            for _ in range(3):
                if size > 1:
                    layer, size = [sha("".join(layer[i : i + 3])) for i in range(0, len(layer), 3)], -(-size // 3)
            want = layer[0]
            draw.shuffle(own)
            cut = draw.randint(0, len(own))
            parts = [merkle.Frontier(n, 3, 3) for _ in range(2)]
            for part, some in zip(parts, (own[:cut], own[cut:]), strict=True):
                for i in some:
                    part.event(i, nodes[i])
            whole = parts[0].merge(parts[1])
            assert whole.top == want and not whole.waiting


def test_missing_nodes_are_an_error(spark):
    nodes = spark.createDataFrame([("t", i, 20, sha(str(i))) for i in range(19)], "tree string, index long, n long, digest string")
    with pytest.raises(Exception, match="nodes of a block are missing"):
        merkle.climb(nodes)

import hashlib
import re
from collections import defaultdict

import pytest
from conftest_llm import documents

from pagewright.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d, t))
    out = []
    for body, members in groups.items():
        keep = sorted(members, key=lambda m: m[:2] + (m[2] or 0,))[0][2]
        out += [(d, keep, len(members), hashlib.sha256(body.encode()).hexdigest()) for _, _, d, _ in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest_bytes", [32, 1, 0])
@pytest.mark.parametrize("files", [True, False])
def test_groups(spark, awkward, tmp_path, digest_bytes, files):
    if digest_bytes == 0 and files:
        pytest.skip("one way is enough")
    docs = documents(spark, awkward, tmp_path / "d" if files else None)
    got = exact_dedup.exact_groups(docs, digest_bytes).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute(awkward)
    kept = [r["doc_id"] for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_state_goes_on_over_batches(spark, awkward, tmp_path):
    docs = documents(spark, awkward * 3, tmp_path / "d").repartition(7)
    docs.write.parquet(str(tmp_path / "e"))
    got = exact_dedup.exact_groups(spark.read.parquet(str(tmp_path / "e")), files_per_batch=1).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute(awkward * 3)


def test_empty_and_pipeline_form(spark, awkward, tmp_path):
    assert exact_dedup.exact_groups(documents(spark, [])).count() == 0
    docs = documents(spark, awkward, tmp_path / "d")
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=repr) == sorted([2, 5, 6, None, 9, 10], key=repr)

import hashlib
import re

from llm.cases import awkward

from stillwater.llm.exact_dedup import exact_dedup


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for norm, members in groups.items():
        members.sort()
        for k, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), k == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_awkward_rows(spark):
    df = awkward(spark)
    got = sorted((tuple(r) for r in exact_dedup(df).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])
    assert exact_dedup(df.limit(0)).count() == 0


def test_a_group_over_all_partitions(spark):
    rows = [(i, "same text" if i % 3 else f"other {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in exact_dedup(df).collect()), key=repr) == brute(rows)


def test_long_equal_starts(spark):
    """Texts that part after the splitters' characters, over many partitions."""
    rows = [(i, "s" * 300 + f" {i % 40}" * (i % 3)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted((tuple(r) for r in exact_dedup(df).collect()), key=repr) == brute(rows)

import hashlib
from collections import defaultdict

from fieldloom.llm import exact_dedup as x
from fieldloom.llm.common import shared_path


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((r[0], keep[r[1] or ""], len(groups[r[1] or ""]), r[0] == keep[r[1] or ""], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows), key=str)


def test_matches_brute_force(odd, odd_rows):
    assert sorted(map(tuple, x.find_copies(odd).collect()), key=str) == expected(odd_rows)


def test_stage_keeps_one_row_of_each_text(odd, odd_rows):
    got = x.drop_copies(odd)
    assert got.columns == odd.columns
    assert sorted((r.text or "") for r in got.collect()) == sorted({r[1] or "" for r in odd_rows})


def test_index_persists_over_batches_and_sessions(spark, odd):
    path = shared_path(spark, "idx")
    first = x.DigestIndex(spark, path, 4)
    x.find_copies(odd.where("doc_id < 130"), first).count()
    again = x.DigestIndex(spark.newSession(), path, 4, "reopened")
    got = {r.doc_id: r for r in x.find_copies(odd.where("doc_id between 125 and 150"), again).collect()}
    assert got[135].keep_id == 129 and not got[135].kept and got[150].kept
    assert again.table().groupBy("digest").count().where("count > 1").count() == 0


def test_empty(none):
    assert x.find_copies(none).collect() == [] and x.drop_copies(none).collect() == []

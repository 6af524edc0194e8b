import re

import corpus_pipeline
from skyweave.llm import near_dedup, registry

from .fixtures import edited, prose, rows, table
from .test_dedup import brute_components


def corpus():
    """Documents in one language, with copies, near copies, personal data and texts without letters."""
    out = [(i, prose(100 + i, 40 + i), "en", "s", 1) for i in range(40)]
    base = prose(70, 120)
    out += [(50, base, "en", "s", 1), (51, base.replace(" ", "\n"), "en", "s", 1), (52, edited(base, 1, 2), "en", "s", 1), (53, edited(base, 2, 2), None, "s", 1)]
    return [*out, (60, "123 456", "en", "s", 1), (61, None, None, None, None), (62, prose(99, 30) + " write a.b@x.org", "en", "s", 1)]


def test_stages(spark, tmp_path):
    data = corpus()
    docs = table(spark, data)
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    ids = lambda name: {r.doc_id for r in seen[name]}
    assert ids("language_id") == {r[0] for r in data} - {60, 61}
    assert ids("exact_dedup") == ids("language_id") - {51}
    left = [r for r in sorted(seen["exact_dedup"]) if r.doc_id is not None]
    tops = brute_components([r.text for r in left])
    assert ids("near_dedup") == {left[i].doc_id for i in set(tops)} == ids("exact_dedup") - {52, 53}
    assert ids("pii") == ids("near_dedup")
    before, after = ({r.doc_id: r.text for r in seen[s]} for s in ("near_dedup", "pii"))
    assert [i for i in before if before[i] != after[i]] == [62] and not re.search(r"a\.b@x", after[62])
    assert {r.doc_id for r in seen["packing"]} == ids("pii")


def test_pipeline_bears_odd_rows(spark, tmp_path):
    for place, data in enumerate((rows(), [])):
        folder = tmp_path / str(place)
        table(spark, data).write.parquet(str(folder / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(folder)).collect()
        assert bool(out) == bool(data)


def test_near_copies_go_by_id_and_text(spark):
    base, other = prose(70, 120), prose(71, 50)
    near = [edited(base, s, 2) for s in range(3)]
    data = [(1, base), (2, near[0]), (2, other), (2, None), (None, near[1]), (None, prose(72, 50)), (3, near[2]), (3, near[2])]
    out = near_dedup.drop_near_copies(table(spark, [(i, t, "en", "s", 1) for i, t in data])).collect()
    assert {(r.doc_id, r.text) for r in out} == {data[i] for i in (0, 2, 3, 5)} and len(out) == 4


def test_every_operator_is_registered():
    assert {int(re.match(r"op(\d+)_", k)[1]) for k in registry.QUERIES} == set(range(1, 14))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)

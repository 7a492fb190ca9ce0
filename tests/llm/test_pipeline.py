"""Each stage of the pipeline on what the stage before has kept."""

from __future__ import annotations

from corpus_pipeline import COLUMNS, STAGES

from ..oracle import SF
from .test_contracts import brute_classes


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    kept = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for name, stage in STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != STAGES[-1][0]:
            assert docs.columns == COLUMNS
            kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    start, clean, single, cut, decontaminated = kept
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    mild = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    assert len(toxic & clean.keys()) <= 0.15 * len(toxic) and len(mild & clean.keys()) >= 0.97 * len(mild & start.keys())
    assert single.keys() == {i for i, c in brute_classes(clean, 5, 80, 100).items() if i == c}
    assert cut.keys() == single.keys()
    windows: dict = {}
    for i, t in single.items():
        w = (t or "").split()
        for j in range(len(w) - 49):
            windows.setdefault(tuple(w[j : j + 50]), []).append((i, j))
    hit: dict = {i: set() for i in single}
    for places in windows.values():
        if len(places) > 1:
            for i, j in places:
                hit[i].update(range(j, j + 50))
    for i, t in single.items():
        assert (cut[i] or "").split() == [w for j, w in enumerate((t or "").split()) if j not in hit[i]]
    assert decontaminated.keys() <= cut.keys()
    packed = {r["doc_id"] for r in docs.collect()}
    assert packed == {i for i, t in decontaminated.items() if t}

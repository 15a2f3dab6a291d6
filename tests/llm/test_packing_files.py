"""Packing writes files by the tasks that read its texts, not by the session's shuffle partitions."""

import os
from contextlib import ExitStack

from merchlens.llm import packing
from merchlens.session import scratch_dir, setting


def test_packing_writes_no_file_per_shuffle_partition(spark, tmp_path, monkeypatch):
    words = "some short words that make texts of many lengths over all of the tasks".split()
    rows = [(i, " ".join(words * (1 + i % 40))) for i in range(300)] + [(None, None), (7, words[0]), (7, words[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folders = []

    def own(spark, name):
        folders.append(scratch_dir(spark, name).removeprefix("file://"))
        return folders[-1]

    monkeypatch.setattr("merchlens.session.scratch_dir", own)
    with ExitStack() as held:
        for k, v in {"shuffle.partitions": 61, "adaptive.coalescePartitions.enabled": "false", "autoBroadcastJoinThreshold": -1}.items():
            held.enter_context(setting(spark, f"spark.sql.{k}", str(v)))
        out = str(tmp_path / "packed")
        packing.pack(docs).write.parquet(out)
    files = {f: sum(x.endswith(".parquet") for x in os.listdir(f)) for f in [*folders, out]}
    assert max(files.values()) <= 8 and sum(files.values()) <= 16, files

    got = spark.read.parquet(out).toPandas()
    assert len(got) == len(rows)  # every text is shorter than a sequence
    assert got.length.value_counts().max() > 7 and len(got.groupby(["sequence_id", "offset"])) == len(got)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        ends = (s.offset + s.length).tolist()
        assert s.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= 2048

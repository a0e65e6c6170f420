"""Writer of meshes as OFF text."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_off(lines: DataFrame, folder: str) -> None:
    """Write ``fid, part_, line, text`` as one text file per mesh, under ``folder/fid=<fid>``.

    Each mesh goes to one task, which writes its lines by part and line, so that memory is bounded by one sort's spill.
    """
    lines.repartition("fid").sortWithinPartitions("fid", "part_", "line").select("fid", "text").write.partitionBy("fid").mode("errorifexists").text(folder)

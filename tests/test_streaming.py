"""The stream gives the verdicts that one batch over all files gives."""

from pyspark.sql import functions as F

from gatelore.streaming.verdicts import netlist_stream, write_verdicts


def test_verdicts_of_arriving_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    chain = "\n".join(f"not g{k}(n{k + 1}, n{k});" for k in range(14))
    (tmp_path / "in/long.v").write_text(chain)
    (tmp_path / "in/short.v").write_text("\n".join(chain.splitlines()[:8]))
    query = write_verdicts(netlist_stream(spark, str(tmp_path / "in"), 1), lambda gates: gates.select("design_id", "gid", F.lit(0.9).alias("p")), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(200)
    got = {r.design_id: (r.gates, r.flagged, r.trojaned) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"long": (14, 14, True), "short": (8, 0, False)}

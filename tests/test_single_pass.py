"""Queries that do a costly step once per row, or in few large pieces."""

from pyspark.sql import functions as F

from quillwave.operators import prompts as P
from quillwave.plans import registry
from quillwave.plans import scripts as S


def test_captions_strip_and_lower_a_prompt_once(spark):
    texts = [None, "", "  \n", " Warm AMBIENT rain ,,", "no vocal drone pads\t", "x , ,,"]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", P.build_caption(F.col("t")).alias("c"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 2 and plan.count("lower(") == 1
    got = {r["i"]: r["c"] for r in made.collect()}
    assert got[0] == P.SUFFIX and got[1] == got[2] == ", ".join([*P.CAPTION_TAGS, P.SUFFIX])
    assert got[3].endswith(f", Warm AMBIENT rain ,,, {P.SUFFIX}") and "ambient" not in got[3] and ", warm," not in got[3] and "no drums" in got[3]
    assert got[4].endswith(", no vocal drone pads") and got[5].endswith(f", x , ,,, {P.SUFFIX}")


def test_scan_of_scripts_makes_a_file_per_script_and_no_folders(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "shared_folder", lambda spark: str(tmp_path / "scripts"))
    n = registry.QUERIES["scan_scripts"](spark, sf_dir).count()
    entries = [p for p in (tmp_path / "scripts").iterdir() if not p.name.startswith((".", "_"))]
    assert n > 0 and sorted(p.suffix for p in entries if p.is_file()) == [".txt"] * n and len(entries) == n

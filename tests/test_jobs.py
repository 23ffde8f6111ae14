"""A job run twice over the same range leaves the same tables."""


def test_detect_events_job_is_repeatable(spark, tmp_path):
    from sunloom.gallery.fixtures import Tables
    from sunloom.gallery.report_queries import plant_plates
    from sunloom.jobs import detect_events
    from sunloom.session import prepare

    t = Tables(prepare(spark), "/root/testdata/sf0.001")
    merged = t.merged.selectExpr("*", "cast(null as double) as i_ac_a")
    out = str(tmp_path / "out")
    sizes = []
    for _ in range(2):
        detect_events.run(spark, merged, plant_plates(t), out)
        diag, events = (spark.read.parquet(f"{out}/{n}") for n in ("diagnostics", "events"))
        sizes.append((diag.count(), events.count()))
    assert sizes[0] == sizes[1] and sizes[0][1] > 0
    assert {"detect_score", "diag_level", "n_tier_a", "diag_reasons"} <= set(events.columns) and "evidence" in diag.columns
    assert events.filter("diag_score is null").count() == 0

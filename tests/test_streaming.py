from meshlark.streaming import ingest


def test_parameters_arrive_over_time(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    (tmp_path / "in").mkdir()
    for name, text in (("a.csv", "1,1,2,3,4\nrun_id2,1,1,1,1\n"), ("b.csv", "\n2,9,9,9,9\n")):
        (tmp_path / "in" / name).write_text(text)
        ingest.append_parameters(ingest.parameter_stream(spark, source), table, state).awaitTermination()
    assert {r.mesh_id: list(r.p) for r in ingest.current_parameters(spark, table).collect()} == {1: [1, 2, 3, 4], 2: [9, 9, 9, 9]}

import __spark_entry__


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_command_line(spark, tmp_path, capsys):
    from recoflux.__main__ import main

    (tmp_path / "n.csv").write_text("a,b,1,1\n")
    (tmp_path / "d.csv").write_text("a,b,2\n")
    (tmp_path / "s.csv").write_text("a,c,0.5\n")
    main(["merge", "--numerators", str(tmp_path / "n.csv"), "--denominators", str(tmp_path / "d.csv"), "--strengths", str(tmp_path / "s.csv"), "--out", str(tmp_path / "out")])
    assert sorted(x for f in (tmp_path / "out").glob("part*") for x in f.read_text().split()[1:]) == ["a,b,1,1,2,", "a,c,,,,0.5"]
    main(["calculate_tf", "--language", "english", "--text", "cook cooking"])
    assert "cook" in capsys.readouterr().out
    main(["summarize_popularities", "--data", "/root/testdata/sf0.001", "--out", str(tmp_path / "store")])
    assert (tmp_path / "store" / "popularity").is_dir()

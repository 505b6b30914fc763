from codeloom import api


def test_projects(spark, tmp_path):
    a = tmp_path / "src/one"
    a.mkdir(parents=True)
    (a / "A.java").write_text("package p;\nimport p.B;\n// a\n// b\n// TODO c\npublic class A extends B {\n  private B other;\n  public void run() { help(); other.go(); }\n  void help() { }\n  void idle() { }\n}\n")
    (a / "B.java").write_text("package p;\nclass B {\n  void go() { go(); }\n}\n")
    (a / "Bad.java").write_text("class {")
    r = api.analyze_projects(spark, str(tmp_path / "src")).first()
    assert (r.n_files, r.n_classes, r.n_methods, r.dead_methods, r.graph_nodes, r.noise_lines) == (3, 2, 4, 1, 6, 3)
    done = api.modernize_projects(spark, str(tmp_path / "src"), str(tmp_path / "out")).first()
    assert (done.files_parsed, done.methods_converted, done.avg_confidence) == (3, 3, 0.5)
    text = (tmp_path / "out/one/a.py").read_text()
    assert "A.run" in text and "A.idle" not in text and (tmp_path / "out/one/b.py").exists()

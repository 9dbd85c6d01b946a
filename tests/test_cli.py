import json

from tessera.__main__ import main


def test_verbs(spark, tmp_path, capsys):
    root = tmp_path / "proj"
    root.mkdir()
    (root / "a.py").write_text("def alpha(value):\n" + "".join(f"    step_{i} = compute(value, {i})\n" for i in range(12)) + "    return step_0\n")
    store = ["--store", str(tmp_path / "store")]

    def run(*args):
        main([*store, *args])
        return capsys.readouterr().out.strip()

    assert json.loads(run("index", str(root)))["indexed"] == 1
    assert json.loads(run("list"))["project_id"] == "proj"
    assert json.loads(run("check", "proj")) == {"state": "unchanged", "count": 1}
    assert run("search", "alpha value compute step", "--project", "proj").startswith("## Result 1")
    assert "total_chunks" in run("stats")
    assert json.loads(run("sync-all"))["unchanged"] == 1
    run("prune")
    assert json.loads(run("delete", "proj"))["files"] == 1
    assert run("search", "alpha value compute step") == "No relevant code found."

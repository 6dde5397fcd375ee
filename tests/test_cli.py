import io

from keyloom.cli import main


def test_arguments_and_standard_input(spark, tmp_path, capsys, monkeypatch):
    store = str(tmp_path / "kv")
    assert main([]) == 2
    assert main([store, "SET", "a", 'two "words"']) == 0
    monkeypatch.setattr("sys.stdin", io.StringIO("GET a\nNOPE\n"))
    assert main([store]) == 1
    assert capsys.readouterr().out.splitlines() == ["OK", '"two \\"words\\""', "(error) ERR unknown command 'NOPE'"]

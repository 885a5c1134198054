"""From a markdown tree to an index, a search and an evaluation, end to end."""

from __future__ import annotations

import json

import pytest

from skeinmill.__main__ import main


def test_index_search_evaluate(spark, tmp_path, capsys):
    docs = tmp_path / "docs"
    (docs / "sub").mkdir(parents=True)
    (docs / "install.md").write_text("# Install\n\nRun pip to install the package quickly.")
    (docs / "sub/train.md").write_text("# Train\n\nThe trainer fits models on data.")
    (docs / "misc.md").write_text("# Misc\n\nNothing of note stands here at all.")
    main(["index", str(docs), str(tmp_path / "index")])
    assert sorted(p.name for p in (tmp_path / "index").iterdir() if p.is_dir()) == ["strategy=fixed", "strategy=header", "strategy=recursive"]
    for pipeline in ("dense", "sparse", "hybrid", "hybrid-rerank"):
        main(["search", str(tmp_path / "index"), "install the package", "--k", "2", "--pipeline", pipeline])
        assert capsys.readouterr().out.startswith("1. install.md::chunk_0")
    (tmp_path / "eval.json").write_text(json.dumps([{"query": "install the package", "relevant": ["install"]}, {"query": "trainer fits models", "relevant": ["sub/train"]}]))
    main(["evaluate", str(tmp_path / "index"), str(tmp_path / "eval.json"), "--report", str(tmp_path / "r.json")])
    report = json.loads((tmp_path / "r.json").read_text())
    assert report["strategies"]["recursive"]["mrr"] == 1.0 and report["pipeline"] == "hybrid"
    capsys.readouterr()
    main(["evaluate", str(tmp_path / "index"), str(tmp_path / "eval.json"), "--baseline", str(tmp_path / "r.json"), "--strategy", "recursive"])
    assert "| recursive | mrr | 1.000 | +0.000 |" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["evaluate", str(tmp_path / "index"), str(tmp_path / "eval.json"), "--eval-k", "0"])

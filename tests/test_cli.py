"""The command line over a small bundle, from files to an answer's context."""

import json

from lexweave.__main__ import extract_bundle, main

ACT = """Section 1. Keepers

(1) Every keeper shall hold "sealed goods" apart.

Provided that a keeper of one box need not.

Section 2. Meanings

(1) "sealed goods" means goods in a closed box.
"""


def run(capsys, spark, *args):
    assert main(list(args), spark) == 0
    return json.loads(capsys.readouterr().out)


def test_from_files_to_context(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "act.txt").write_text(ACT)
    out = f"file://{tmp_path}/bundle"
    assert run(capsys, spark, "ingest", f"file://{tmp_path}/in", "-o", out)["documents"] == "1"
    first = run(capsys, spark, "embed", out)
    again = run(capsys, spark, "embed", out)
    assert first["nodes_embedded"] == 5 and again["nodes_embedded"] == 0 and again["nodes_skipped"] == 5
    plain = run(capsys, spark, "query", out, "every keeper shall hold goods apart", "-k", "1")
    assert plain["sound"] and plain["n_seeds"] == 1 and plain["n_closure"] >= 2 and "Provided that" in plain["context"]
    more = run(capsys, spark, "query", out, "every keeper shall hold goods apart", "-k", "1", "--glosses", "--use-vectors", "--rerank", "--min-confidence", "0.5")
    assert more["sound"] and "sealed goods [= " in more["context"]
    assert run(capsys, spark, "extract", out)["admitted"] == 2

    def model(said, labels):
        return [{"src": "N3", "dst": "N2", "type": "exception_of", "evidence": "a keeper of one box", "confidence": 0.9}] if "N3" in labels else []

    done = extract_bundle(spark, out, model, "m")
    assert done["calls"] == 2 and done["candidates"] == 1 and done["rejected"] == 0

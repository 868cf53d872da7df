import json

import pytest

from keelstone.__main__ import main


def test_commands(spark, tmp_path):
    item = {"id": "1", "type": 1, "name": "A", "login": {"username": "u", "password": "secret", "uris": [{"uri": "https://a", "match": None}]}, "folderId": "f", "x": 1}
    src = tmp_path / "e.json"
    src.write_text(json.dumps({"items": [item, item | {"id": "2"}], "folders": [{"id": "f", "name": "Main"}]}))
    assert main(["dedup", "-i", str(src)]) == 0
    doc, gone, audit = (json.loads((tmp_path / f"e.dedup{x}.json").read_text()) for x in ("", ".trashed", ".audit"))
    assert [i["id"] for i in doc["items"]] == ["1"] and [i["id"] for i in gone["items"]] == ["2"] and audit["trashed"] == 1 and len(audit["entries"]) == 1 and "secret" not in json.dumps(audit)
    with pytest.raises(FileExistsError):
        main(["dedup", "-i", str(src)])
    assert main(["move", "-i", str(src), "--folder", "new"]) == 0
    moved = json.loads((tmp_path / "e.in-folder-new.json").read_text())
    assert {i["folderId"] for i in moved["items"]} == {moved["folders"][0]["id"]} and moved["items"][0]["x"] == 1
    assert main(["redact", "-i", str(src)]) == 0
    safe = (tmp_path / "e.redacted.json").read_text()
    assert "secret" not in safe and len(json.loads(safe)["items"]) == 2 and json.loads(safe)["items"][0]["folderId"] == json.loads(safe)["folders"][0]["id"]
    with pytest.raises(ValueError):
        main(["dedup", "-i", str(src), "-o", str(src)])

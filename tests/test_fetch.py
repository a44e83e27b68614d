import json

import pytest

from folio.session import ship
from folio.sources.fetch import fetch_audit, fetch_planned


def test_failed_sources_are_audited(spark, tmp_path):
    ship(spark)
    (tmp_path / "good.jsonl").write_text("\n".join(json.dumps({"doc_id": f"d{i}", "title": "t", "text": None}) for i in range(5)))
    (tmp_path / "bad.jsonl").write_text("{")
    (tmp_path / "none.jsonl").write_text("")
    plan = [{"name": "good", "max_docs": 3}, {"name": "bad"}, {"name": "none"}, {"name": "gone"}]
    rows = fetch_planned(spark, plan, str(tmp_path))
    got = {r.name: (r.fetched, bool(r.error)) for r in fetch_audit(plan, rows).collect()}
    assert got == {"good": (3, False), "bad": (0, True), "none": (0, False), "gone": (0, True)}
    with pytest.raises(Exception):
        fetch_planned(spark, plan, str(tmp_path), strict=True).collect()

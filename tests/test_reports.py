from factweave.operators import creds
from factweave.plans import report
from tests.inline import inline


def test_every_ungrouped_form_is_listed(spark):
    c = inline(spark, [(i, f"http://own{i}.example/", [f"field[]=pwd{i}", f"title[]=T{i}"]) for i in range(25)])
    lines = report.kit_lines(c).where("part = 1").collect()
    assert sorted(r["place"] for r in lines) == sorted(r["artifact_id"] for r in creds.ungrouped_forms(c.credential_forms, c.factions[0]).collect()) == list(range(25))

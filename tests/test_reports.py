import json

from conftest import SF_SMALL
from jobscope.operators import reports as R
from jobscope.queries import analysis


def test_documents_parse_back_to_sections(spark):
    a = analysis(spark, SF_SMALL)
    docs = R.export_user_documents(a, spark).collect()
    parsed = {}
    for d in docs:
        if d.section is None:
            continue
        parsed.setdefault((d.user, d.section), []).append(json.loads(d.entry))
    for name, fn in R.SECTIONS.items():
        sec = fn(a, spark)
        for r in sec.groupBy("user").count().collect():
            assert len(parsed.get((r.user, name), [])) == r["count"], (name, r.user)
    jobs = {e["Job"] for e in parsed.get((docs[0].user, "JobInfo"), [])}
    assert all(isinstance(j, int) for j in jobs)


def test_problem_listing_uses_dictionary_names(spark):
    a = analysis(spark, SF_SMALL)
    names = {p[1] for p in R.PROBLEMS}
    got = {r.problem for r in R.problem_listing(a, spark).select("problem").distinct().collect()}
    assert got and got <= names
    assert R.unknown_problems(a, spark).count() == 0

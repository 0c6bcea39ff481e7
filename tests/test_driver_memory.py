"""What a query needs in the driver does not grow with the questions."""

from graphloom.operators import closure, scoring, visits
from graphloom.plans import workload
from graphloom.session import written


def test_no_table_of_runs_or_questions_is_broadcast(spark, small, monkeypatch):
    """A broadcast is built in the driver; the files of many runs are small, their rows are not."""
    t = {name: written(df, name) for name, df in workload.tables(spark, small).items()}
    sent = []

    def noting(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        sent.extend((name, line) for line in plan.splitlines() if "Broadcast" in line)
        return written(df, name)

    monkeypatch.setattr(closure, "written", noting)
    monkeypatch.setattr(visits, "written", noting)
    runs = noting(visits.runs_of(t["plans"], ["core11"]), "runs")
    branches = noting(visits.execute(runs, *[t[k] for k in ("constraints", "names", "edges", "units", "candidates")]), "branches")
    outcomes = noting(visits.outcomes(branches, runs, t["plans"], t["names"]), "outcomes")
    scores = noting(scoring.score_cases(outcomes, branches, t["gold"]), "scores")
    assert sent == []
    assert scores.count() == runs.count()

"""How many rows a query's joins give."""


def most_rows(df, step="Join"):
    """The most rows that a join, or another step, of an executed plan gives."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        if "Adaptive" in p.getClass().getSimpleName():
            p = p.executedPlan()
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
        if step in p.nodeName() and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return most

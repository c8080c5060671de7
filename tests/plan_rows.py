"""The rows that a query's joins made, from the metrics of its plan."""


def most_joined(df):
    """Runs df; returns its rows and the most rows that one of its joins made."""
    rows, most = df.collect(), 0
    plans = [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            plans.append(p.executedPlan())
        elif "QueryStage" in name:
            plans.append(p.plan())
        else:
            plans += [p.children().apply(i) for i in range(p.children().size())]
            made = p.metrics().get("numOutputRows")
            if "Join" in name and made.isDefined():
                most = max(most, made.get().value())
    return rows, most

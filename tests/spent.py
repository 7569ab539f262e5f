"""What running a DataFrame takes."""

from __future__ import annotations


def most_rows(df) -> int:
    """Rows of the largest operator of the plan, once it has run."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        rows = node.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def shuffled_rows(spark, run) -> tuple:
    """What a function returns, and the rows that its stages wrote to shuffles."""
    sc = spark.sparkContext

    def written() -> dict:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    out = run()
    return out, sum(n for k, n in written().items() if k not in before)

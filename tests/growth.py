"""What a query's operators put out, read from Spark's own record of the last execution."""


def rows_out(spark, df, *kinds):
    """Runs ``df``; the most rows that any operator whose name holds one of ``kinds`` put out."""
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last().executionId()
    values, nodes, most = store.executionMetrics(last), store.planGraph(last).allNodes().iterator(), 0
    while nodes.hasNext():
        node = nodes.next()
        metrics = node.metrics().iterator()
        while metrics.hasNext():
            metric = metrics.next()
            found = values.get(metric.accumulatorId())
            if metric.name() == "number of output rows" and any(k in node.name() for k in kinds) and found.isDefined():
                most = max(most, int(found.get().replace(",", "")))
    return most

import datetime as dt

from pyspark.sql import functions as F


def monthly_frame(spark, values, repo="a/b", metric="m", start=dt.date(2020, 1, 1)):
    rows = []
    y, m = start.year, start.month
    for v in values:
        rows.append((repo, metric, dt.date(y, m, 1), float(v)))
        m += 1
        if m == 13:
            y, m = y + 1, 1
    return spark.createDataFrame(rows, "repo STRING, metric STRING, ds DATE, y DOUBLE")


def daily_frame(spark, values, repo="a/b", metric="m", start=dt.date(2020, 1, 1)):
    rows = [(repo, metric, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "repo STRING, metric STRING, ds DATE, y DOUBLE")


def col_list(df, c, order="ds"):
    return [r[0] for r in df.orderBy(order).select(F.col(c)).collect()]

"""Query registry: every entry pairs a DataFrame plan with SQL for an independent engine."""

import re

from pyspark.sql import functions as F

from worktally.plans.fixtures import CHECK_VIEWS, VIEWS
from worktally.session import prepare

QUERIES = {}
ORACLES = {}
_SQL_TYPES = {"long": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}


def spread_rows(df):
    """Deals rows over all cores when the scan has fewer splits than cores (a single row group);
    large tables have more splits and are left as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Tables:
    """Lazy access to the given tables (``t.events``) and derived views (``t.fx_entry``)."""

    def __init__(self, spark, sf_dir, spread=False):
        self.spark, self.sf_dir, self.spread, self._seen = spark, sf_dir, spread, {}

    def __getattr__(self, name):
        if name.startswith("__"):
            raise AttributeError(name)
        if name not in self._seen:
            if name in VIEWS:
                text = VIEWS[name]
                needs = set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text))
                self._seen[name] = self.spark.sql(text, **{n: getattr(self, n) for n in needs})
            else:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
                self._seen[name] = spread_rows(df) if self.spread else df
        return self._seen[name]


def _plain(text):
    """View text for the check engine: placeholders become names, doubled braces single ones."""
    return re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", text).replace("{{", "{").replace("}}", "}")


def _with_views(body):
    """Prefix the CTEs a check query refers to, in dependency order."""
    every = {**{n: _plain(s) for n, s in VIEWS.items()}, **CHECK_VIEWS}
    order = []

    def visit(text):
        for name in re.findall(r"\b(?:fx|ck)_\w+", text):
            if name in every and name not in order:
                visit(every[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({every[n]})" for n in order) + "\n" + body


def query(name, columns, sql=None, heavy=False):
    """Register ``fn(tables) -> DataFrame``; both sides are cast to the declared columns.

    ``heavy`` marks plans with much work per row: their input is spread over the cores first.
    """
    cols = [c.strip().split(":") for c in columns.split(",")]

    def wrap(fn):
        def run(spark, sf_dir):
            out = fn(Tables(prepare(spark), sf_dir, spread=heavy))
            return out.select(*[F.col(c).cast(t).alias(c) for c, t in cols])

        QUERIES[name] = run
        if sql is not None:
            picks = ", ".join(f'CAST("{c}" AS {_SQL_TYPES[t]}) AS "{c}"' for c, t in cols)
            ORACLES[name] = f"SELECT {picks} FROM (\n{_with_views(sql)}\n) AS answer"
        return fn

    return wrap

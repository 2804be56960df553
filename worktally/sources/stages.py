"""Written stages: a frame that several later steps read is built once.

A stage is a Parquet table in the folder the cluster shares, so it survives lost executors and cuts the plan there: what
follows starts from a plain scan that prunes columns, instead of building the same rows again for each use.
"""

from worktally.session import shared_folder


def staged(df, name):
    """Writes ``df`` below the shared folder and returns it as a table; rows, columns and types are unchanged."""
    home = shared_folder(df.sparkSession, f"stage-{name}")
    df.write.parquet(home)
    return df.sparkSession.read.schema(df.schema).parquet(home)

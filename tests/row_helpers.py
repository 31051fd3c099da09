"""Helpers of the tests outside llm/."""


def ids(df, col="item_id"):
    return sorted(r[col] for r in df.select(col).collect())

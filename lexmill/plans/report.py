"""Results as text, for a terminal."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows a report shows at most.
MOST_ROWS = 200


def table(df: DataFrame, columns: list[str] | None = None, digits: int = 3) -> str:
    """A table of at most 200 rows with aligned columns."""
    columns = columns or df.columns
    rows = [[f"{v:.{digits}f}" if isinstance(v, float) else "-" if v is None else str(v) for v in (r[c] for c in columns)] for r in df.select(*columns).limit(MOST_ROWS).collect()]
    width = [max(map(len, col)) for col in zip(columns, *rows, strict=True)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(line, width, strict=True)).rstrip() for line in [columns, *rows])


def hits(page: DataFrame) -> str:
    """A numbered list of results with score, title, address and snippet."""
    lines = []
    for r in page.orderBy("qid", "rank").limit(MOST_ROWS).collect():
        lines += [f"{r['rank']}. {r['title']} ({r['score']:.4f})", f"   {r['url'] or '-'}", f"   {r['snippet']}"]
    return "\n".join(lines) or "no results"

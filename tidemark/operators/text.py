"""Text to events: links, dates, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Month names.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
DATE = r"([0-9]{1,2}) (" + "|".join(MONTHS) + r") ([0-9]{4})"


def links(pages: DataFrame, ending: str) -> DataFrame:
    """Distinct link targets of each page that end in the pattern, joined to the page's ``url`` unless they name a host."""
    found = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href")).where(F.col("href").rlike(f"(?i){ending}$"))
    host, folder = F.regexp_extract("url", "^[a-z]+://[^/]*", 0), F.regexp_replace("url", "[^/]*$", "")
    whole = F.when(F.col("href").rlike("^[a-z]+://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(host, "href")).otherwise(F.concat(folder, "href"))
    return found.select("page_id", whole.alias("link")).distinct()


def date_in(text: Column) -> Column:
    """The first date written like 5 June 2020; null if there is none or it doesn't exist."""
    parts = [F.regexp_extract(text, f"(?i){DATE}", k) for k in (1, 2, 3)]
    month = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), F.lower(parts[1])).cast("int")
    return F.try_to_date(F.concat_ws("-", parts[2], F.lpad(month.cast("string"), 2, "0"), F.lpad(parts[0], 2, "0")), "yyyy-MM-dd")


def section_changes(docs: DataFrame, key: str, text: str, ticker: str = "[A-Z]{1,5}") -> DataFrame:
    """Ticker lines with the action of the last section heading above them."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("no", "line"))
    heading = F.upper("line")
    action = F.when(heading.contains("ADDITION"), "ADD").when(heading.contains("DELETION") | heading.contains("REMOVAL"), "REMOVE")
    w = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    carried = lines.withColumn("action", F.last(action, ignorenulls=True).over(w)).withColumn("ticker", F.trim("line"))
    return carried.where(F.col("action").isNotNull() & F.col("ticker").rlike(f"^(?:{ticker})$")).select(key, "no", "ticker", "action")


def table_changes(docs: DataFrame, key: str, cells: str, ticker: str = "[A-Z]{1,5}") -> DataFrame:
    """Tickers of each table with its action. ``cells``: rows of cells; the first row decides ADD or REMOVE (else the table is ignored), and each other row gives its first cell that is a ticker.

    A table without rows, or null, gives nothing and stops no other.
    """
    heading = F.upper(F.array_join(F.get(cells, 0), " "))
    action = F.when(heading.contains("ADDITION"), "ADD").when(heading.contains("DELETION") | heading.contains("REMOVAL"), "REMOVE")
    rows = docs.select(key, action.alias("action"), F.posexplode(cells).alias("no", "row")).where("no > 0 and action is not null")
    first = F.get(F.filter("row", lambda c: F.trim(c).rlike(f"^(?:{ticker})$")), 0)
    return rows.select(key, "no", F.trim(first).alias("ticker"), "action").where("ticker is not null")

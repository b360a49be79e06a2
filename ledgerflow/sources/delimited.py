"""Delimited-text sources: typed scans with malformed-record quarantine,
header skipping, layout routing and optional inputs.

Records are read as text lines and parsed with ``from_csv`` into a struct
that carries a corrupt-record column.  Unlike ``spark.read.csv`` with
``DROPMALFORMED`` / ``PERMISSIVE``, the set of rows kept this way does not
depend on which columns the query above reads: every field is parsed for
every line, so ``count()``, one column and all columns agree.  Lines are
split by the text source, so large files are read in parallel splits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.errors import AnalysisException

CORRUPT = "_corrupt"
HEAD = "__head"  # the line is in the first split of its file
FILE = "__file"


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per text line (column ``value``), with its file and whether it
    is in the file's first split (only there a header can be)."""
    lines = spark.read.text(paths if isinstance(paths, list) else [paths])
    return lines.select("value", F.col("_metadata.file_path").alias(FILE),
                        (F.col("_metadata.file_block_start") == 0).alias(HEAD))


def _field(quote: str | None) -> str:
    """One field with the comma before it.  A quote opens a quoted field only
    where the field starts (a backslash escapes), and the field ends with the
    quote that a comma or the line's end follows; every other quote is a
    character of its field.  Possessive, so linear in the line's length."""
    if not quote:
        return ",[^,]*"
    q = "\\" + quote if quote in ".^$*+?()[]{}|\\-" else quote
    inside = f"[^{q}\\\\]*+(?:\\\\.[^{q}\\\\]*+)*+"
    return f",(?:{q}{inside}{q}(?=,|$)|[^,]*)"


def split_fields(value: str = "value", quote: str | None = "'") -> F.Column:
    """Fields of a delimited line, quotes and all.  A comma inside a quoted
    field does not split."""
    found = F.regexp_extract_all(F.concat(F.lit(","), F.col(value)), F.lit(_field(quote)), F.lit(0))
    return F.transform(found, lambda x: F.substring(x, F.lit(2), F.length(x)))


def first_field(value: str = "value") -> F.Column:
    """First comma-separated field, trimmed, quotes stripped, lower-cased."""
    raw = F.split(F.col(value), ",", 2).getItem(0)
    return F.lower(F.btrim(F.btrim(raw), F.lit("'\"")))


def is_header(lines: DataFrame, names: list[str], value: str = "value") -> F.Column:
    """The line is a header: it holds exactly the expected column names
    (quotes stripped, any case), and is in the first split of its file.  A
    record whose first field happens to read like a column name is none."""
    fields = F.transform(F.split(F.col(value), ","), lambda x: F.lower(F.btrim(F.btrim(x), F.lit("'\""))))
    same = fields == F.array(*[F.lit(n.lower()) for n in names])
    return (same & F.col(HEAD)) if HEAD in lines.columns else same


def drop_headers(lines: DataFrame, layouts: list[list[str]], value: str = "value") -> DataFrame:
    """Drop header lines (of any of the layouts' column names) and blank
    lines.  A record whose first field is empty is kept: it parses to a NULL
    there."""
    head = reduce(lambda x, y: x | y, [is_header(lines, names, value) for names in layouts])
    return lines.filter(~head & (F.trim(F.col(value)) != ""))


def _with_corrupt(schema: StructType) -> StructType:
    return StructType(list(schema.fields) + [StructField(CORRUPT, StringType(), True)])


def parse_lines(lines: DataFrame, schema: StructType, quote: str = '"',
                value: str = "value", keep_raw: bool = False) -> DataFrame:
    """Parse each line into ``schema`` plus ``_corrupt`` (the raw line when
    the record is malformed: wrong field count or an unparseable field)."""
    opts = {"quote": quote, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    rec = F.from_csv(F.col(value), _with_corrupt(schema).simpleString(), opts).alias("__r")
    cols = [rec] + ([F.col(value)] if keep_raw else [])
    return lines.select(*cols)


def split_malformed(lines: DataFrame, schema: StructType, quote: str = '"',
                    value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good typed rows, quarantined raw lines with a reason)."""
    parsed = parse_lines(lines, schema, quote, value, keep_raw=True)
    # keep-or-drop through a generator instead of a filter: a filter on the
    # parsed struct would be pushed below the parse and run the parser twice
    keep = F.when(F.col(f"__r.{CORRUPT}").isNull(), F.array(F.col("__r")))
    good = parsed.select(F.explode(keep).alias("__g")).select(
        *[F.col(f"__g.{f.name}").alias(f.name) for f in schema.fields])
    bad = with_reason(parsed, schema, quote, value).filter(F.col("reason").isNotNull()).select(
        F.col(value).alias("raw"), "reason")
    return good, bad


REASONS = ("too_few_fields", "too_many_fields", "bad_value")


def with_reason(parsed: DataFrame, schema: StructType, quote: str = '"',
                value: str = "value") -> DataFrame:
    """Why a parsed line is malformed; NULL for a good record."""
    n = len(schema.fields)
    nfields = field_count(value, quote)
    reason = (F.when(nfields < n, REASONS[0]).when(nfields > n, REASONS[1]).otherwise(REASONS[2]))
    return parsed.withColumn("reason", F.when(F.col(f"__r.{CORRUPT}").isNotNull(), reason))


def quarantine_summary(bad: DataFrame) -> DataFrame:
    """Row count per quarantine reason."""
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))


def read_typed(spark: SparkSession, paths: str | list[str], schema: StructType,
               quote: str = '"', header: bool = True) -> DataFrame:
    """Typed scan of delimited text, malformed records dropped (see
    ``read_split`` for them).  With ``header`` the header line of every file
    is skipped, where it holds the schema's column names."""
    return read_split(spark, paths, schema, quote, header)[0]


def read_split(spark: SparkSession, paths: str | list[str], schema: StructType,
               quote: str = '"', header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good typed rows, quarantined raw lines with a reason)."""
    lines = read_lines(spark, paths)
    if header:
        lines = drop_headers(lines, [schema.fieldNames()])
    return split_malformed(lines, schema, quote)


def ingest_counts(spark: SparkSession, paths: str | list[str], schema: StructType,
                  quote: str = '"') -> DataFrame:
    """One row (n_good, n_dropped and one count per reason): what
    ``read_typed`` keeps and drops, in one scan."""
    lines = drop_headers(read_lines(spark, paths), [schema.fieldNames()])
    tagged = with_reason(parse_lines(lines, schema, quote, keep_raw=True), schema, quote)
    return tagged.agg(F.count_if(F.col("reason").isNull()).alias("n_good"),
                      F.count_if(F.col("reason").isNotNull()).alias("n_dropped"),
                      *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])


@dataclass(frozen=True)
class Ingested:
    """What ``ingest`` wrote: the typed records, the quarantined lines (raw,
    reason), and how many of each (``n_good``, ``n_dropped``, one per reason)."""
    good: DataFrame
    bad: DataFrame
    counts: dict[str, int]


def ingest(spark: SparkSession, paths: str | list[str], schema: StructType, out: str,
           quote: str = '"') -> Ingested:
    """Read and parse delimited text once, into a Parquet table at ``out``
    that is partitioned by ``outcome``: ``good``, or why a line is malformed.
    Both sides and the counts come from that one write (the counts are observed
    on it); whoever reads the good side next reads typed columns, not text."""
    lines = drop_headers(read_lines(spark, paths), [schema.fieldNames()])
    tagged = with_reason(parse_lines(lines, schema, quote, keep_raw=True), schema, quote)
    good = F.col("reason").isNull()
    # the parsed record and the line go through a generator, as in split_malformed
    row = F.struct(*[F.when(good, F.col(f"__r.{f.name}")).alias(f.name) for f in schema.fields],
                   F.when(~good, F.col("value")).alias(RAW), F.coalesce("reason", F.lit(GOOD)).alias(OUTCOME))
    rows = tagged.select(F.explode(F.array(row)).alias("__w")).select("__w.*")
    obs = Observation()
    names = {"n_good": F.col(OUTCOME) == GOOD, "n_dropped": F.col(OUTCOME) != GOOD,
             **{r: F.col(OUTCOME) == r for r in REASONS}}
    (rows.observe(obs, *[F.count_if(c).alias(n) for n, c in names.items()])
     .write.mode("overwrite").partitionBy(OUTCOME).parquet(out))
    whole = StructType([*schema.fields, StructField(RAW, StringType()), StructField(OUTCOME, StringType())])
    written = spark.read.schema(whole).parquet(out)
    return Ingested(written.filter(F.col(OUTCOME) == GOOD).select(*schema.fieldNames()),
                    written.filter(F.col(OUTCOME) != GOOD).select(F.col(RAW).alias("raw"), F.col(OUTCOME).alias("reason")),
                    {n: int(obs.get[n]) for n in names})


RAW, OUTCOME, GOOD = "_raw", "outcome", "good"


def read_paysim(spark, paths):
    from ..schemas import PAYSIM
    return read_typed(spark, paths, PAYSIM)


def read_banksim_tx(spark, paths):
    from ..schemas import BANKSIM_TX
    return read_typed(spark, paths, BANKSIM_TX, quote="'")


def read_banksim_net(spark, paths):
    from ..schemas import BANKSIM_NET
    return read_typed(spark, paths, BANKSIM_NET, quote="'")


def field_count(value: str = "value", quote: str | None = "'") -> F.Column:
    """Number of fields of a delimited line, as ``split_fields`` finds them:
    an apostrophe inside a field (O'Neil) opens nothing."""
    return F.regexp_count(F.concat(F.lit(","), F.col(value)), F.lit(_field(quote)))


def tag_records(lines: DataFrame, layouts: list[tuple[str, StructType, F.Column]],
                quote: str = "'", value: str = "value") -> DataFrame:
    """Read a text input that holds several record layouts in one scan: one
    row per record with ``layout`` (the first whose predicate holds, else
    NULL), one struct column per layout (NULL for the others' records) and
    ``malformed``.  Predicates may use ``__nf``, the line's field count
    (quotes respected).  Header and blank lines are dropped."""
    body = drop_headers(lines, [s.fieldNames() for _, s, _ in layouts], value)
    body = body.withColumn("__nf", field_count(value, quote))
    which = reduce(lambda e, lay: e.when(lay[2], F.lit(lay[0])), layouts[1:],
                   F.when(layouts[0][2], F.lit(layouts[0][0])))
    body = body.select(value, which.alias("layout"))
    opts = {"quote": quote, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    for name, schema, _ in layouts:
        body = body.withColumn(name, F.from_csv(F.when(F.col("layout") == name, F.col(value)),
                                                _with_corrupt(schema).simpleString(), opts))
    bad = F.coalesce(*[F.col(name)[CORRUPT] for name, _, _ in layouts]).isNotNull()
    # through a generator, so that no filter is pushed below the parse and runs it again
    rec = F.struct("layout", *[n for n, _, _ in layouts], (bad | F.col("layout").isNull()).alias("malformed"))
    return body.select(F.explode(F.array(rec)).alias("__t")).select("__t.*")


def route_records(lines: DataFrame, layouts: list[tuple[str, StructType, F.Column]],
                  quote: str = "'", value: str = "value") -> dict[str, DataFrame]:
    """One DataFrame per layout out of ``tag_records``; malformed records and
    those of no layout are dropped (count them with ``tag_records``).  A
    caller that needs all layouts at once takes ``tag_records``: one scan."""
    tagged = tag_records(lines, layouts, quote, value)
    return {name: tagged.filter((F.col("layout") == name) & ~F.col("malformed")).select(
        *[F.col(f"{name}.{f.name}").alias(f.name) for f in schema.fields]) for name, schema, _ in layouts}


def default_layouts():
    """Routing by field count: 11 -> PaySim, >= 10 -> BankSim, 5 -> network."""
    from ..schemas import BANKSIM_NET, BANKSIM_TX, PAYSIM
    n = F.col("__nf")
    return [("paysim", PAYSIM, n == 11), ("banksim_tx", BANKSIM_TX, n >= 10),
            ("banksim_net", BANKSIM_NET, n == 5)]


class NoInput(RuntimeError):
    """None of the given paths exists."""


def load_available_or_none(spark: SparkSession, paths: list[str], reader) -> list[DataFrame]:
    """Like ``load_available`` but an empty list when nothing exists."""
    try:
        return load_available(spark, paths, reader)
    except NoInput:
        return []


def load_available(spark: SparkSession, paths: list[str], reader) -> list[DataFrame]:
    """Apply ``reader(spark, path)`` to each path that exists; a missing path
    is skipped (any Hadoop file system: the check is Spark's own path
    resolution).  No input at all raises."""
    frames = []
    for p in paths:
        try:
            frames.append(reader(spark, p))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "Path does not exist" not in str(e):
                raise
    if not frames:
        raise NoInput(f"no input data found in {paths}")
    return frames

"""Data quality: expectation suites, model tests, record validation, freshness.

A suite is a list of ``Check`` objects.  ``run_suite`` evaluates *all* checks of
a suite in one scan of the input: a row's failed checks are the bits of one number, and
the counts per number and per unique key are grouping sets of one aggregate.  The
former fold to a few rows in each task, so all that is shuffled is each key with its
count (a key that a third of all rows share is one row per task).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlens import constants as K
from merchlens.functions.numeric import pct_text, safe_div
from merchlens.functions.text import mcc_pad


@dataclass(frozen=True)
class Check:
    kind: str                       # not_null | in_set | between | unique | pair_not_null | row_count | expression
    column: str | None = None
    other: str | None = None
    values: tuple = field(default_factory=tuple)
    lo: float | None = None
    hi: float | None = None
    expression: str | None = None   # SQL predicate that must hold (expression check)
    label: str | None = None

    @property
    def name(self) -> str:
        if self.kind == "not_null":
            return f"expect_column_values_to_not_be_null({self.column})"
        if self.kind == "in_set":
            return f"expect_column_values_to_be_in_set({self.column})"
        if self.kind == "between":
            return f"expect_column_values_to_be_between({self.column}, {_num(self.lo)}, {_num(self.hi)})"
        if self.kind == "unique":
            return f"expect_column_values_to_be_unique({self.column})"
        if self.kind == "pair_not_null":
            return f"expect_referential_integrity({self.column} → {self.other})"
        if self.kind == "row_count":
            return "expect_table_row_count_to_be_between"
        return self.label or f"expect_expression({self.expression})"

    @property
    def expected(self) -> str:
        if self.kind == "not_null":
            return "0 nulls"
        if self.kind == "in_set":
            shown = ", ".join(repr(v) for v in sorted(self.values)[:5])
            return f"values in [{shown}]..."
        if self.kind in ("between", "row_count"):
            return f"[{_num(self.lo)}, {_num(self.hi)}]"
        if self.kind == "unique":
            return "0 duplicates"
        if self.kind == "pair_not_null":
            return "0 referential integrity violations"
        return "0 violations"


def _num(v) -> str:
    return str(v)


def _blank(c: Column, dtype: str) -> Column:
    """Null, or empty text for string columns (Q1)."""
    return (c.isNull() | (c == "")) if dtype == "string" else c.isNull()


def _bad(chk: Check, df: DataFrame) -> Column:
    """Condition that a row fails the check (row checks only)."""
    c = F.col(chk.column) if chk.column else None
    dtype = dict(df.dtypes).get(chk.column, "string") if chk.column else None
    if chk.kind == "not_null":
        return _blank(c, dtype)
    if chk.kind == "in_set":
        allowed = [str(v).lower() for v in chk.values]
        return c.isNotNull() & ~F.lower(c.cast("string")).isin(allowed)
    if chk.kind == "between":
        if dtype == "string":
            x = F.expr(f"try_cast(nullif(`{chk.column}`, '') AS DOUBLE)")
            return F.nullif(c, F.lit("")).isNotNull() & (x.isNull() | ~x.between(chk.lo, chk.hi))
        x = c.cast("double")
        return x.isNotNull() & ~x.between(chk.lo, chk.hi)
    if chk.kind == "pair_not_null":
        return c.isNotNull() & F.col(chk.other).isNull()
    if chk.kind == "expression":
        return ~F.expr(chk.expression)
    raise ValueError(chk.kind)


#: Conditions whose outcomes share one number.
_BITS = 60


def count_failures(df: DataFrame, bad: dict[str, Column], unique: dict[str, Column]) -> DataFrame:
    """One row: ``_total``, rows meeting each condition of ``bad``, and for each column of ``unique`` its values that repeat an
    earlier one (nulls aside).  One scan; exact, since keys are compared and not their hashes."""
    names = list(bad)
    masks = {f"_m{j}": names[j:j + _BITS] for j in range(0, max(len(names), 1), _BITS)}

    def bits(part: list[str]) -> Column:
        total = F.lit(0).cast("long")
        for i, n in enumerate(part):
            total = total + F.when(bad[n], F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
        return total

    keys = {f"_k{i}": c for i, c in enumerate(unique.values())}
    flat = df.select(*[bits(part).alias(m) for m, part in masks.items()], *[c.alias(k) for k, c in keys.items()])
    columns = [*masks, *keys]
    sets = flat.groupingSets([[F.col(c)] for c in columns], *columns).agg(
        F.count(F.lit(1)).alias("_n"), *[F.grouping(c).alias(f"_by{c}") for c in columns])

    def summed(column: str, where: Column, n: Column) -> Column:
        return F.coalesce(F.sum(F.when((F.col(f"_by{column}") == 0) & where, n)), F.lit(0).cast("long"))

    n, every = F.col("_n"), F.lit(True)
    out = [summed("_m0", every, n).alias("_total")]
    out += [summed(m, F.col(m).bitwiseAND(F.lit(1 << i).cast("long")) != 0, n).alias(name)
            for m, part in masks.items() for i, name in enumerate(part)]
    out += [summed(k, F.col(k).isNotNull(), n - 1).alias(name) for k, name in zip(keys, unique)]
    return sets.agg(*out)


def _observed(chk: Check, n: Column, total: Column) -> Column:
    if chk.kind == "not_null":
        pct = F.coalesce(safe_div(n * 100.0, total), F.lit(0.0))
        return F.concat(n.cast("string"), F.lit("/"), total.cast("string"), F.lit(" null ("),
                        pct_text(pct, 1), F.lit(")"))
    if chk.kind == "in_set":
        return F.concat(n.cast("string"), F.lit(" invalid values"))
    if chk.kind == "between":
        return F.concat(n.cast("string"), F.lit(" out-of-range"))
    if chk.kind == "unique":
        return F.concat(n.cast("string"), F.lit(" duplicates"))
    if chk.kind == "pair_not_null":
        return F.concat(n.cast("string"), F.lit(f" records with {chk.column} set but {chk.other} null"))
    if chk.kind == "row_count":
        return n.cast("string")
    return F.concat(n.cast("string"), F.lit(" violations"))


def _success(chk: Check, n: Column) -> Column:
    if chk.kind == "row_count":
        return n.between(chk.lo, chk.hi)
    return n == 0


def run_suite(df: DataFrame, checks: list[Check], suite_name: str) -> DataFrame:
    """Evaluate every check in one pass; one output row per check."""
    rows_checked = {f"_f{i}": _bad(ch, df) for i, ch in enumerate(checks) if ch.kind not in ("unique", "row_count")}
    one = count_failures(df, rows_checked, {f"_f{i}": F.col(ch.column) for i, ch in enumerate(checks) if ch.kind == "unique"})
    one = one.withColumns({f"_f{i}": F.col("_total") for i, ch in enumerate(checks) if ch.kind == "row_count"})
    total = F.col("_total")
    rows = [
        F.struct(
            F.lit(i + 1).alias("check_no"),
            F.lit(ch.name).alias("expectation"),
            _success(ch, F.col(f"_f{i}")).alias("success"),
            _observed(ch, F.col(f"_f{i}"), total).alias("observed"),
            F.lit(ch.expected).alias("expected"),
            (F.lit(0).cast("long") if ch.kind == "row_count" else F.col(f"_f{i}")).alias("failures"),
        )
        for i, ch in enumerate(checks)
    ]
    return one.select(F.lit(suite_name).alias("suite_name"), F.explode(F.array(*rows)).alias("r")).select(
        "suite_name", "r.*")


def failed_samples(df: DataFrame, checks: list[Check], suite_name: str, id_col: str = "transaction_id", n: int = 5) -> DataFrame:
    """T4: per failed check its first ``n`` failing rows by id (then by value): ``(suite_name, check_no, expectation,
    sample_no, id, value)``.  A row is paired with the checks that it fails and no others, and a task keeps ``n`` rows of each check
    before anything is shuffled.  A uniqueness check shows repeated values."""
    rows, numbered = [], list(enumerate(checks, 1))
    by_row = [(i, ch) for i, ch in numbered if ch.kind not in ("unique", "row_count")]
    if by_row:
        failed = F.array(*[F.when(_bad(ch, df), F.struct(F.lit(i).alias("check_no"), F.col(ch.column).cast("string").alias("value")
                                                         if ch.column else F.lit(None).cast("string").alias("value")))
                           for i, ch in by_row])
        rows.append(df.select(F.col(id_col).cast("string").alias("id"), F.explode(F.array_compact(failed)).alias("r")).select("id", "r.*"))
    for i, ch in numbered:
        if ch.kind == "unique":
            c = F.col(ch.column)
            again = df.where(c.isNotNull()).groupBy(c.cast("string").alias("id")).count().where("count > 1")
            rows.append(again.select("id", F.lit(i).alias("check_no"), F.col("count").cast("string").alias("value")))
    if not rows:
        raise ValueError("no check of rows or keys")
    pairs = rows[0]
    for r in rows[1:]:
        pairs = pairs.unionByName(r)
    first = Window.partitionBy("check_no").orderBy(F.col("id").asc_nulls_first(), F.col("value").asc_nulls_first())
    kept = pairs.withColumn("sample_no", F.row_number().over(first)).where(F.col("sample_no") <= n)
    name = F.element_at(F.array(*[F.lit(ch.name) for ch in checks]), F.col("check_no"))
    return kept.select(F.lit(suite_name).alias("suite_name"), "check_no", name.alias("expectation"), "sample_no",
                       F.col("id").alias(id_col), "value")


def raw_suite(min_rows: int = K.RAW_ROWCOUNT_MIN, max_rows: int = K.RAW_ROWCOUNT_MAX) -> list[Check]:
    """Q7: the 13 raw-layer checks; the row-count bounds are those of the table at hand."""
    return [
        Check("row_count", lo=min_rows, hi=max_rows),
        Check("not_null", "transaction_id"),
        Check("not_null", "merchant_id"),
        Check("not_null", "transaction_amount"),
        Check("not_null", "mcc_code"),
        Check("not_null", "city"),
        Check("unique", "transaction_id"),
        Check("in_set", "mcc_code", values=tuple(K.SUITE_VALID_MCC)),
        Check("in_set", "acceptance_method", values=tuple(K.ACCEPTANCE_METHODS)),
        Check("between", "transaction_amount", lo=K.AMOUNT_MIN, hi=K.AMOUNT_MAX),
        Check("between", "stars", lo=K.STARS_MIN, hi=K.STARS_MAX),
        Check("between", "price_range", lo=K.PRICE_MIN, hi=K.PRICE_MAX),
        Check("pair_not_null", "merchant_id", other="merchant_name"),
    ]


def staging_suite() -> list[Check]:
    """Q8: the 6 staging-layer checks."""
    return [
        Check("not_null", "transaction_id"),
        Check("not_null", "merchant_id"),
        Check("unique", "transaction_id"),
        Check("in_set", "transaction_value_tier", values=tuple(K.VALUE_TIERS)),
        Check("in_set", "transaction_quarter", values=tuple(K.QUARTERS)),
        Check("between", "transaction_amount", lo=K.AMOUNT_MIN, hi=K.AMOUNT_MAX),
    ]


def suite_report(results: DataFrame) -> DataFrame:
    """Q9: evaluated / passed / failed / percent per suite."""
    passed = F.count(F.when(F.col("success"), F.lit(1)))
    total = F.count(F.lit(1))
    return results.groupBy("suite_name").agg(
        total.alias("evaluated_expectations"),
        passed.alias("successful_expectations"),
        (total - passed).alias("unsuccessful_expectations"),
        pct_text(passed * 100.0 / total, 1).alias("success_percent"),
        (passed == total).alias("success"),
    )


# --- Q10: model tests (unique / not_null / accepted_values / expression_is_true) ---

def model_test(df: DataFrame, model: str, tests: list[tuple[str, str, object]]) -> DataFrame:
    """Run (column, test, arg) tests in one pass; accepted_values is case-sensitive
    and ignores nulls, not_null counts only nulls, expression rows failing NOT(expr)."""
    bad, unique = {}, {}
    for i, (col, test, arg) in enumerate(tests):
        c = F.col(col)
        if test == "unique":
            unique[f"_t{i}"] = c
        elif test == "not_null":
            bad[f"_t{i}"] = c.isNull()
        elif test == "accepted_values":
            bad[f"_t{i}"] = ~c.isin(list(arg))
        elif test == "expression_is_true":
            bad[f"_t{i}"] = ~F.expr(f"`{col}` {arg}")
        else:
            raise ValueError(test)
    one = count_failures(df, bad, unique)
    rows = [F.struct(F.lit(model).alias("model"), F.lit(col).alias("column_name"), F.lit(test).alias("test"),
                     F.col(f"_t{i}").alias("failures"),
                     F.when(F.col(f"_t{i}") == 0, F.lit("pass")).otherwise(F.lit("fail")).alias("status"))
            for i, (col, test, arg) in enumerate(tests)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


SOURCE_TESTS = [
    ("transaction_id", "unique", None), ("transaction_id", "not_null", None),
    ("merchant_id", "not_null", None),
    ("mcc_code", "not_null", None), ("mcc_code", "accepted_values", tuple(K.MODEL_TEST_VALID_MCC)),
    ("transaction_amount", "not_null", None), ("transaction_amount", "expression_is_true", "> 0"),
    ("acceptance_method", "accepted_values", tuple(K.ACCEPTANCE_METHODS)),
]
STAGING_TESTS = [
    ("transaction_id", "unique", None), ("transaction_id", "not_null", None),
    ("merchant_id", "not_null", None),
    ("transaction_amount", "not_null", None),
    ("transaction_amount", "expression_is_true", "> 0 AND transaction_amount < 100000"),
    ("mcc_code", "not_null", None),
    ("transaction_value_tier", "accepted_values", tuple(K.VALUE_TIERS)),
    ("transaction_quarter", "accepted_values", tuple(K.QUARTERS)),
]
MART_TESTS = [
    ("merchant_id", "unique", None), ("merchant_id", "not_null", None),
    ("avg_transaction_amount", "not_null", None), ("avg_transaction_amount", "expression_is_true", "> 0"),
]


# --- Q11 / U3: per-record validation ---

REQUIRED_FIELDS = ["city", "mcc_code", "merchant_id", "merchant_name", "transaction_amount"]


def validate_records(df: DataFrame) -> DataFrame:
    """One row per record with its list of issues (missing fields, MCC, amount, name)."""
    c = F.col
    missing = F.array_compact(F.array(*[F.when(c(f).isNull(), F.lit(f)) for f in REQUIRED_FIELDS]))
    mcc = F.coalesce(mcc_pad(c("mcc_code")), F.lit("None"))
    amt = c("transaction_amount").cast("double")
    issues = F.array_compact(F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit("Missing fields: "), F.array_join(missing, ", "))),
        F.when(~mcc.isin(K.VALIDATION_VALID_MCC), F.concat(F.lit("Invalid MCC code: "), mcc)),
        F.when(amt.isNull(), F.lit("Non-numeric amount: None"))
         .when(~amt.between(K.AMOUNT_MIN, K.AMOUNT_MAX),
               F.concat(F.lit("Amount out of range: "), amt.cast("string"))),
        F.when(c("merchant_id").isNotNull() & F.coalesce(c("merchant_name"), F.lit("")).eqNullSafe(""),
               F.lit("merchant_id set but merchant_name is null")),
    ))
    return df.select(
        "merchant_id",
        F.size(issues).cast("long").alias("n_issues"),
        F.array_join(issues, "; ").alias("issues"),
        (F.size(issues) == 0).alias("passed"),
    )


def validation_summary(records: DataFrame) -> DataFrame:
    """Q11: pass rate and the 95 % gate."""
    total = F.count(F.lit(1))
    passed = F.count(F.when(F.col("passed"), F.lit(1)))
    rate = F.coalesce(safe_div(passed, total), F.lit(0.0))
    return records.agg(
        total.alias("total"), passed.alias("passed"), (total - passed).alias("failed"),
        pct_text(rate * 100, 1).alias("pass_rate"),
        F.when(rate >= K.VALIDATION_PASS_RATE, F.lit("pass")).otherwise(F.lit("fail")).alias("status"),
        (rate >= K.VALIDATION_PASS_RATE).alias("ready_for_embedding"),
    )


def issues_sample(records: DataFrame, n: int = 5) -> DataFrame:
    """T4: the first n failing records (by merchant id) — a bounded top-n, not a collect."""
    return records.where(~F.col("passed")).orderBy("merchant_id").limit(n)


# --- Q12: freshness ---

def freshness(df: DataFrame, as_of: str, ts_col: str = "transaction_at",
              fallback_col: str | None = "ingested_at") -> DataFrame:
    """Age class per record: >= 7 days critical, >= 3 warning, else fresh; no time -> critical."""
    ts = F.col(ts_col) if fallback_col is None else F.coalesce(F.col(ts_col), F.col(fallback_col))
    age = F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(ts.cast("timestamp")))
                  / F.lit(86400000000.0))
    status = (F.when(ts.isNull(), F.lit("critical"))
              .when(age >= K.FRESHNESS_CRITICAL_DAYS, F.lit("critical"))
              .when(age >= K.FRESHNESS_WARNING_DAYS, F.lit("warning"))
              .otherwise(F.lit("fresh")))
    return df.select("merchant_id", "merchant_name", age.alias("age_days"), status.alias("status"),
                     F.when(ts.isNull(), F.lit("No timestamp available")).alias("reason"))


def freshness_report(records: DataFrame) -> DataFrame:
    """Q12 summary; critical only above a 10 % share."""
    total = F.count(F.lit(1))
    crit = F.count(F.when(F.col("status") == "critical", F.lit(1)))
    warn = F.count(F.when(F.col("status") == "warning", F.lit(1)))
    fresh = F.count(F.when(F.col("status") == "fresh", F.lit(1)))
    return records.agg(
        F.when(crit / F.greatest(total, F.lit(1)) > K.FRESHNESS_CRITICAL_SHARE, F.lit("critical"))
         .when(warn > 0, F.lit("warning")).otherwise(F.lit("healthy")).alias("status"),
        total.alias("total"), fresh.alias("fresh"), warn.alias("stale_warning"), crit.alias("stale_critical"),
        pct_text(F.coalesce(safe_div(fresh * 100.0, total), F.lit(0.0)), 1).alias("freshness_pct"),
    )


# --- F7: ingest validation of incoming transaction records ---

# Fields a transaction record must carry (null = missing on a fixed schema, L24).
INGEST_REQUIRED = ["merchant_id", "merchant_name", "transaction_amount", "mcc_code", "mcc_description",
                   "city", "state", "latitude", "longitude"]


def ingest_reason(df: DataFrame) -> Column:
    """'; '-joined reasons a record fails the transaction model, '' when it passes:
    missing required fields (in field order), a negative amount, an acceptance
    method outside the enum (case-sensitive; null takes the default 'chip')."""
    parts = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in INGEST_REQUIRED]
    parts.append(F.when(F.col("transaction_amount") < 0, F.lit("transaction_amount < 0")))
    acc = F.col("acceptance_method")
    parts.append(F.when(acc.isNotNull() & ~acc.isin(*K.ACCEPTANCE_METHODS), F.lit("acceptance_method not allowed")))
    return F.concat_ws("; ", *parts)


def validate_ingest(df: DataFrame) -> DataFrame:
    """Every record with ``is_valid`` / ``reason`` and the model's coercions
    (MCC zero-padded without truncation, default acceptance method) — one
    narrow projection, no shuffle."""
    r = ingest_reason(df)
    return df.withColumns({
        "reason": F.nullif(r, F.lit("")),
        "mcc_code": mcc_pad("mcc_code"),
        "acceptance_method": F.coalesce(F.col("acceptance_method"), F.lit(K.DEFAULT_ACCEPTANCE)),
    }).withColumn("is_valid", F.col("reason").isNull())


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects-with-reason) over the same validated frame."""
    v = validate_ingest(df)
    return v.where("is_valid").drop("is_valid", "reason"), v.where(~F.col("is_valid")).drop("is_valid")

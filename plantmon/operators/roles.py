"""Column roles and the projections built on them.

A role is kept in the column's metadata, so it survives ``select``, joins and
staged tables without a side object.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantmon.functions.numeric import col, is_finite
from plantmon.plans import lookup, rank_within

# Roles that never become model inputs, and the roles a task
# falls back to when its targets are not named.
NON_INPUT_ROLES = ("time", "group", "episode", "segment", "mask", "label", "fault_id", "target")
TARGET_FALLBACK = {
    "mpc": ("target", "output", "state", "quality"),
    "prediction": ("target", "quality", "output"),
    "imputation": (),
    "reconstruction": (),
    "classification": ("fault_id", "label", "target"),
    "fault_diagnosis": ("fault_id", "label", "target"),
    "other": ("target", "fault_id", "label", "quality"),
}


def with_roles(df: DataFrame, roles: Mapping[str, str], **extra: Mapping[str, str]) -> DataFrame:
    """Record ``{column: role}`` (and e.g. ``unit={column: text}``) as metadata."""
    out = []
    for field in df.schema:
        meta = dict(field.metadata)
        if field.name in roles:
            meta["role"] = roles[field.name]
        for key, values in extra.items():
            if field.name in values:
                meta[key] = values[field.name]
        out.append(F.col(field.name).alias(field.name, metadata=meta))
    return df.select(*out)


def role_of(df: DataFrame) -> dict[str, str]:
    """Role of every column; a column without one is an input."""
    return {f.name: f.metadata.get("role", "input") for f in df.schema}


def role_columns(df: DataFrame, role: str) -> list[str]:
    return [c for c, r in role_of(df).items() if r == role]


def resolve(df: DataFrame, selectors: Sequence[str]) -> list[str]:
    """Ordered, unique columns named by roles or by column names."""
    known = set(role_of(df).values())
    chosen: list[str] = []
    for selector in selectors:
        found = role_columns(df, selector) if selector in known else [selector]
        absent = [c for c in found if c not in df.columns]
        if absent:
            raise ValueError(f"selector {selector!r} names missing columns {absent}")
        chosen += [c for c in found if c not in chosen]
    return chosen


def select_roles(df: DataFrame, selectors: Sequence[str]) -> DataFrame:
    return df.select(*resolve(df, selectors))


def task_targets(
    df: DataFrame, task: str, targets: Sequence[str] = (), label: str | None = None
) -> list[str]:
    """Label column, else the named targets, else the task's fallback roles."""
    if label is not None:
        return resolve(df, [label])
    if targets:
        return resolve(df, targets)
    for role in TARGET_FALLBACK.get(task, TARGET_FALLBACK["other"]):
        found = role_columns(df, role)
        if found:
            return found
    return []


def task_inputs(
    df: DataFrame, task: str, inputs: Sequence[str] = (), targets: Sequence[str] | None = None
) -> list[str]:
    """Named inputs, else every column that is neither target nor bookkeeping."""
    if inputs:
        return resolve(df, inputs)
    taken = set(task_targets(df, task) if targets is None else targets)
    roles = role_of(df)
    return [c for c in df.columns if c not in taken and roles[c] not in NON_INPUT_ROLES]


def task_view(
    df: DataFrame,
    task: str,
    *,
    keys: Sequence[str] = (),
    inputs: Sequence[str] = (),
    targets: Sequence[str] = (),
    label: str | None = None,
) -> DataFrame:
    """Project keys, inputs ``in_*`` and targets ``out_*`` of a task.

    A reconstruction or imputation task without targets reconstructs its inputs.
    """
    outs = task_targets(df, task, targets, label)
    ins = task_inputs(df, task, inputs, outs)
    if not outs and task in ("reconstruction", "imputation"):
        outs = ins
    return df.select(
        *keys,
        *[F.col(c).alias(f"in_{c}") for c in ins if c not in keys],
        *[F.col(c).alias(f"out_{c}") for c in outs if c not in keys],
    )


def feature_scope(df: DataFrame, scope: str) -> list[str]:
    """Columns an operator reads: input, target, quality, u or input_target."""
    scope = scope.strip().lower()
    names = {"x": "input", "y": "target", "control": "u"}
    scope = names.get(scope, scope)
    inputs, targets = role_columns(df, "input"), role_columns(df, "target")
    picked = {
        "input": inputs,
        "target": targets,
        "quality": role_columns(df, "quality") or targets,
        "u": role_columns(df, "control"),
        "input_target": inputs + targets,
    }
    if scope not in picked:
        raise ValueError(f"unknown feature scope {scope!r}; use one of {sorted(picked)}")
    if not picked[scope]:
        raise ValueError(f"feature scope {scope!r} has no columns")
    return picked[scope]


def drop_columns(df: DataFrame, names: Sequence[str | int]) -> tuple[DataFrame, DataFrame]:
    """Drop by name or position; the report says which requests were missing."""
    resolved = []
    for item in names:
        if isinstance(item, int):
            inside = -len(df.columns) <= item < len(df.columns)
            resolved.append((str(item), df.columns[item] if inside else None))
        else:
            resolved.append((item, item if item in df.columns else None))
    gone = [c for _, c in resolved if c is not None]
    report = df.sparkSession.createDataFrame(
        [(asked, found is not None) for asked, found in resolved],
        "requested string, dropped boolean",
    )
    return df.drop(*gone), report


def to_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Strict cast to double: a value that is no number fails the job."""
    return df.withColumns(
        {
            c: F.when(
                F.expr(f"try_cast(`{c}` as double)").isNull() & F.col(c).isNotNull(),
                F.raise_error(F.concat(F.lit(f"column {c} is not numeric: "), F.col(c).cast("string"))).cast("double"),
            ).otherwise(F.expr(f"try_cast(`{c}` as double)"))
            for c in columns
        }
    )


def split_xy(df: DataFrame, targets: Sequence[int] = (-1,)) -> tuple[list[str], list[str]]:
    """Input and target names by position; the last column is the target."""
    ys = [df.columns[i] for i in targets]
    return [c for c in df.columns if c not in ys], ys


def label_mapping(df: DataFrame, label: str, normal: str | None = None) -> DataFrame:
    """Class ids 0.. over the sorted distinct labels, the normal one first."""
    text = F.col(label).cast("string")
    classes = df.where(text.isNotNull()).select(text.alias(label)).distinct()
    first = F.when(F.col(label) == F.lit(normal), 0).otherwise(1)
    return rank_within(classes, [], [first, label], "class_id")


def encode_labels(
    df: DataFrame, label: str, mapping: DataFrame | None = None, normal: str | None = None
) -> DataFrame:
    """Add ``class_id``; a label missing from the mapping fails the job.

    Labels that are all numeric keep their own values.
    """
    if mapping is None:
        text = F.col(label).cast("string")
        non_numeric = df.where(text.isNotNull() & F.expr(f"try_cast(`{label}` as double)").isNull())
        if not non_numeric.take(1):
            return df.withColumn("class_id", F.col(label).cast("double").cast("long"))
        mapping = label_mapping(df, label, normal)
    keyed = df.withColumn(label, F.col(label).cast("string"))
    joined = lookup(keyed, mapping, label)
    known = F.col("class_id").isNotNull() | F.col(label).isNull()
    return joined.withColumn(
        "class_id",
        F.when(known, F.col("class_id")).otherwise(
            F.raise_error(F.concat(F.lit("unknown label "), F.col(label))).cast("long")
        ),
    )


def unseen_labels(df: DataFrame, label: str, mapping: DataFrame) -> DataFrame:
    """Labels with no class id, with their row counts."""
    counts = df.groupBy(F.col(label).cast("string").alias(label)).agg(F.count("*").alias("rows"))
    return counts.join(mapping, label, "left_anti")


def concat_vectors(name: str, *parts: Sequence[str | Column]) -> Column:
    """One array column from several channel lists, in order."""
    flat = [col(c).cast("double") for part in parts for c in part]
    return F.array(*flat).alias(name)


def wide_to_long(
    df: DataFrame, keys: Sequence[str], streams: Sequence[str],
    name: str = "score_name", value: str = "score",
) -> DataFrame:
    return df.unpivot(list(keys), list(streams), name, value)


def long_to_wide(
    df: DataFrame, keys: Sequence[str], streams: Sequence[str],
    name: str = "score_name", value: str = "score",
) -> DataFrame:
    """Streams are named by the caller, so no extra job looks for them."""
    return df.groupBy(*keys).pivot(name, list(streams)).agg(F.first(value))


def union_segments(*segments: DataFrame) -> DataFrame:
    """Bag union by column name; a column absent in one segment is null there."""
    out = segments[0]
    for s in segments[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def complete_rows(df: DataFrame, columns: Sequence[str]) -> Column:
    """True where every listed column is finite."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & is_finite(c)
    return keep


"""Run settings as rows: defaults, checks as data, derived switches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barlab.functions.indicators import ATR_METHODS, TrueRangeAverage
from barlab.schemas import SERIES

# --- fixed values: setting, type, default ---
CONFIG_FIELDS: list[tuple[str, str, object]] = [
    ("pair", "string", None),
    ("timeframe", "string", None),
    ("strategy_name", "string", None),
    ("start_date", "string", None),
    ("end_date", "string", None),
    ("initial_capital", "double", None),
    ("fixed_position_size", "double", None),
    ("position_sizing_mode", "string", "fixed"),
    ("risk_percent", "double", None),
    ("account_currency", "string", "USD"),
    ("strategy_params", "map<string,string>", None),
    ("spread", "double", 0.0),
    ("slippage", "double", 0.0),
    ("fee_per_trade", "double", 0.0),
    ("allow_long", "boolean", True),
    ("allow_short", "boolean", True),
    ("one_position_at_a_time", "boolean", True),
    ("stop_loss_mode", "string", None),
    ("stop_loss", "double", None),
    ("take_profit_mode", "string", None),
    ("take_profit", "double", None),
    ("trailing_stop_mode", "string", None),
    ("trailing_stop", "double", None),
    ("trailing_type", "string", "standard"),
    ("trailing_activation_mode", "string", None),
    ("trailing_activation", "double", None),
    ("chandelier_multiplier", "double", None),
    ("chandelier_atr_period", "int", 14),
    ("chandelier_atr_method", "string", "wilder"),
    ("break_even_mode", "string", None),
    ("break_even", "double", None),
    ("break_even_buffer_mode", "string", None),
    ("break_even_buffer", "double", None),
    ("ma_stop", "boolean", False),
    ("ma_stop_source", "string", "short"),
    ("ma_stop_buffer_mode", "string", None),
    ("ma_stop_buffer", "double", None),
    ("atr_period", "int", 14),
    ("atr_method", "string", "wilder"),
]
CONFIG_NAMES = [name for name, _, _ in CONFIG_FIELDS]

# Settings that are a distance with a mode: absolute price or ATR multiple.
DISTANCES = ["stop_loss", "take_profit", "trailing_stop", "trailing_activation", "break_even"]
BUFFERS = ["break_even_buffer", "ma_stop_buffer"]
MODES = ("absolute", "atr")


def _quoted(value: object) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _literal(dtype: str, value: object) -> str:
    if value is None:
        return f"CAST(NULL AS {dtype})"
    if isinstance(value, dict):
        return f"CAST(map({', '.join(_quoted(part) for item in value.items() for part in item)}) AS {dtype})"
    if isinstance(value, bool) or not isinstance(value, str):
        return f"CAST({_quoted(value)} AS {dtype})"
    return _quoted(value)


def _settings(template: int, settings: dict) -> str:
    """One run's settings as a SQL struct, defaults filled in."""
    unknown = sorted(set(settings) - set(CONFIG_NAMES))
    if unknown:
        raise ValueError(f"Unknown settings: {unknown}")
    fields = [f"'{name}', {_literal(dtype, settings.get(name, default))}" for name, dtype, default in CONFIG_FIELDS]
    return f"named_struct('template', {template}, {', '.join(fields)})"


def _runs(templates: list[dict]) -> Column:
    return F.explode(F.expr(f"array({', '.join(_settings(i, t) for i, t in enumerate(templates))})"))


def config_table(spark: SparkSession, runs: list[dict]) -> DataFrame:
    """A config DataFrame from a few hand-written runs."""
    return with_run_id(spark.range(1).select(_runs(runs).alias("run")).select("run.*"))


def configs_per_series(series: DataFrame, templates: list[dict]) -> DataFrame:
    """Every template for every series of ``series`` (columns pair, timeframe)."""
    exploded = series.select(*SERIES).distinct().withColumn("run", _runs(templates))
    filled = exploded.selectExpr(
        "run.template", *SERIES, *[f"run.{name} AS {name}" for name in CONFIG_NAMES if name not in SERIES]
    )
    return with_run_id(filled)


def with_run_id(configs: DataFrame) -> DataFrame:
    """Deterministic id: strategy, window and the first ten hex digits of a SHA-1 of all settings."""
    payload = F.to_json(F.struct(*sorted(CONFIG_NAMES)), {"ignoreNullFields": "false"})
    stem = "replace(replace(coalesce({0}, 'None'), ':', ''), ' ', '_')"
    return configs.withColumn("digest", F.sha1(payload)).selectExpr(
        *configs.columns,
        f"concat_ws('_', coalesce(strategy_name, 'None'), {stem.format('start_date')}, "
        f"{stem.format('end_date')}, substring(digest, 1, 10)) AS run_id",
    )


def normalize_configs(configs: DataFrame) -> DataFrame:
    """Lower-case names, fill implied modes and buffers; bad values stay for the checks."""
    replaced = {
        "break_even_buffer": "CASE WHEN break_even IS NOT NULL THEN coalesce(break_even_buffer, 0D) ELSE break_even_buffer END",
        "ma_stop_buffer": "CASE WHEN ma_stop THEN coalesce(ma_stop_buffer, 0D) ELSE ma_stop_buffer END",
        "position_sizing_mode": "lower(trim(coalesce(position_sizing_mode, 'fixed')))",
        "trailing_type": "lower(trim(coalesce(trailing_type, 'standard')))",
        "ma_stop_source": "lower(trim(coalesce(ma_stop_source, 'short')))",
        "atr_method": "lower(trim(atr_method))",
        "chandelier_atr_method": "lower(trim(chandelier_atr_method))",
    }
    for name in DISTANCES + BUFFERS:
        is_set = f"({replaced.get(name, name)}) IS NOT NULL"
        replaced[f"{name}_mode"] = (
            f"CASE WHEN {is_set} THEN lower(trim(coalesce({name}_mode, 'absolute'))) ELSE {name}_mode END"
        )
    return configs.selectExpr(*[f"{replaced.get(c, c)} AS {c}" for c in configs.columns])


def _distance_checks(name: str, zero_allowed: bool = False) -> list[tuple[str, str]]:
    too_small, wording = ("< 0", "zero or positive") if zero_allowed else ("<= 0", "positive")
    return [
        (f"{name} IS NULL AND {name}_mode IS NOT NULL", f"{name}_mode requires {name} to be set."),
        (f"{name} {too_small}", f"{name} must be {wording} when provided."),
        (f"{name}_mode NOT IN {MODES}", f"Unsupported {name}_mode."),
    ]


def _atr_checks(prefix: str) -> list[tuple[str, str]]:
    return [
        (f"{prefix}_period IS NULL OR {prefix}_period <= 0", f"{prefix}_period must be a positive integer."),
        (f"{prefix}_method IS NULL OR {prefix}_method NOT IN {ATR_METHODS}", f"Unsupported {prefix}_method."),
    ]


FIXED, RISK = "position_sizing_mode = 'fixed'", "position_sizing_mode = 'risk_percent'"
STANDARD, CHANDELIER = "trailing_type = 'standard'", "trailing_type = 'chandelier'"
TRAILS = f"({STANDARD} AND trailing_stop IS NOT NULL OR {CHANDELIER} AND chandelier_multiplier IS NOT NULL)"


def config_checks() -> list[tuple[str, str]]:
    """(violated, message) pairs over a normalised config row; the first violation counts."""
    return [
        ("position_sizing_mode NOT IN ('fixed', 'risk_percent')", "Unsupported position_sizing_mode."),
        ("initial_capital IS NULL OR initial_capital <= 0", "initial_capital must be positive."),
        (
            f"{FIXED} AND (fixed_position_size IS NULL OR fixed_position_size <= 0)",
            "fixed_position_size must be positive when position_sizing_mode='fixed'.",
        ),
        (
            f"{RISK} AND (risk_percent IS NULL OR risk_percent <= 0)",
            "risk_percent must be positive when position_sizing_mode='risk_percent'.",
        ),
        (
            f"{RISK} AND stop_loss IS NULL AND NOT ma_stop",
            "position_sizing_mode='risk_percent' requires an entry-time stop from stop_loss or ma_stop.",
        ),
        *[(f"{cost} < 0", f"{cost} must be zero or positive.") for cost in ("spread", "slippage", "fee_per_trade")],
        ("NOT allow_long AND NOT allow_short", "At least one of allow_long or allow_short must be enabled."),
        ("NOT one_position_at_a_time", "Only one_position_at_a_time=True is supported."),
        *_distance_checks("stop_loss"),
        *_distance_checks("take_profit"),
        ("trailing_type NOT IN ('standard', 'chandelier')", "Unsupported trailing_type."),
        *_distance_checks("trailing_stop"),
        *_distance_checks("trailing_activation"),
        *_distance_checks("break_even"),
        *_distance_checks("break_even_buffer", zero_allowed=True),
        ("ma_stop_source NOT IN ('short', 'long')", "Unsupported ma_stop_source."),
        (
            "NOT ma_stop AND (ma_stop_buffer IS NOT NULL OR ma_stop_buffer_mode IS NOT NULL)",
            "ma_stop_buffer and ma_stop_buffer_mode require ma_stop to be enabled.",
        ),
        *_distance_checks("ma_stop_buffer", zero_allowed=True),
        (
            f"trailing_activation IS NOT NULL AND NOT {TRAILS}",
            "trailing_activation requires trailing stop configuration.",
        ),
        (
            f"{STANDARD} AND chandelier_multiplier IS NOT NULL",
            "chandelier_multiplier is only used with trailing_type='chandelier'.",
        ),
        (
            f"{CHANDELIER} AND (trailing_stop IS NOT NULL OR trailing_stop_mode IS NOT NULL)",
            "trailing_stop and trailing_stop_mode are not used with trailing_type='chandelier'.",
        ),
        (
            f"{CHANDELIER} AND (chandelier_multiplier IS NULL OR chandelier_multiplier <= 0)",
            "trailing_type='chandelier' requires a positive chandelier_multiplier.",
        ),
        *[(f"{CHANDELIER} AND ({violated})", message) for violated, message in _atr_checks("chandelier_atr")],
        *_atr_checks("atr"),
    ]


def _any_atr(names: list[str]) -> str:
    return "coalesce(array_contains(array({}), 'atr'), false)".format(
        ", ".join(f"coalesce({name}_mode, '')" for name in names)
    )


def check_configs(configs: DataFrame) -> DataFrame:
    """Normalised configs plus ``error`` (NULL when valid) and the switches the ledger reads."""
    error = " ".join(f"WHEN {violated} THEN {_quoted(message)}" for violated, message in config_checks())
    at_entry = ["stop_loss", "take_profit", "trailing_activation", "break_even", "break_even_buffer"]
    ratchets = f"({TRAILS} OR break_even IS NOT NULL OR ma_stop)"
    return normalize_configs(configs).selectExpr(
        "*",
        f"CASE {error} END AS error",
        f"{_any_atr(DISTANCES + BUFFERS)} AS uses_atr",
        f"{_any_atr(at_entry)} AS needs_entry_atr",
        f"{TRAILS} AS trails",
        f"{ratchets} AS ratchets",
        f"({ratchets} OR stop_loss IS NOT NULL OR take_profit IS NOT NULL) AS has_exit_level",
        "concat('atr_', atr_method, '_', atr_period) AS atr_series",
        "concat('atr_', chandelier_atr_method, '_', chandelier_atr_period) AS chandelier_series",
    )


def required_atrs(checked: DataFrame) -> list[TrueRangeAverage]:
    """Distinct ATR settings of the valid runs (a handful of names, whatever the number of runs)."""
    valid = checked.where("error IS NULL")
    plain = valid.where("uses_atr").selectExpr("atr_method AS method", "atr_period AS period")
    chandelier = valid.where(f"trails AND {CHANDELIER}").selectExpr(
        "chandelier_atr_method AS method", "chandelier_atr_period AS period"
    )
    return [TrueRangeAverage(row.method, row.period) for row in plain.union(chandelier).distinct().collect()]

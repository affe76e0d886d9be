"""Extraction records: nested results to flat rows, validation, classes of interactions, audits of tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The closed vocabularies of an interaction record.
VOCABULARIES = {
    "interaction_type": "pharmacokinetic pharmacodynamic both unspecified".split(),
    "mechanism": (
        "CYP_inhibition CYP_induction P-gp_inhibition P-gp_induction UGT_inhibition UGT_induction transporter_modulation absorption_alteration protein_binding_displacement receptor_synergism "
        "receptor_antagonism additive_toxicity synergistic_efficacy antagonistic_efficacy signaling_pathway_modulation organ_toxicity_modulation other unspecified"
    ).split(),
    "direction": "exposure_increase exposure_decrease effect_increase effect_decrease no_change context_dependent".split(),
    "evidence_type": "in_vitro in_vivo_animal human_PK_study clinical_trial case_report review in_silico".split(),
    "clinical_significance": "high moderate low none not_assessed".split(),
}
TEXT_FIELDS = "herb_name_latin herb_common_name herb_active_compound drug_name drug_class interaction_type mechanism specific_target direction tcm_formula_name tcm_pattern evidence_type clinical_significance evidence_quote".split()
NUMBER_FIELDS = "auc_change_pct cmax_change_pct half_life_change_pct cl_change_pct confidence".split()
INTERACTION = T.StructType(
    [T.StructField(f, T.StringType()) for f in TEXT_FIELDS] + [T.StructField(f, T.DoubleType()) for f in NUMBER_FIELDS] + [T.StructField("co_herbs", T.ArrayType(T.StringType())), T.StructField("sample_size", T.LongType())]
)
EXTRACTION = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("contains_hdi", T.BooleanType()), T.StructField("interactions", T.ArrayType(INTERACTION)), T.StructField("extraction_notes", T.StringType())])
RESULT = T.StructType(
    [T.StructField("record_id", T.StringType()), T.StructField("cluster_id", T.LongType()), T.StructField("year", T.LongType()), T.StructField("ok", T.BooleanType()), T.StructField("extraction", EXTRACTION)]
    + [T.StructField(f, T.StringType()) for f in ("tier_used", "error")]
    + [T.StructField(f, T.LongType()) for f in ("n_attempts", "input_tokens", "output_tokens")]
    + [T.StructField("validation_failures", T.LongType()), T.StructField("elapsed_s", T.DoubleType())]
)


def record_rows(results: DataFrame) -> DataFrame:
    """SRC10: one row a record."""
    e = F.col("extraction")
    return results.select(
        "record_id", "year", "cluster_id", F.coalesce("ok", F.lit(False)).alias("ok"), e["contains_hdi"].alias("contains_hdi"), F.coalesce(F.size(e["interactions"]), F.lit(0)).alias("n_interactions"),
        "tier_used", "n_attempts", "validation_failures", "input_tokens", "output_tokens", "elapsed_s", e["extraction_notes"].alias("extraction_notes"), "error",
    ).withColumn("n_interactions", F.greatest("n_interactions", F.lit(0)))


def flatten_interactions(results: DataFrame) -> DataFrame:
    """SRC10, JSN3: one row an interaction with its ordinal; lists become text with bars."""
    each = results.select("record_id", "year", "cluster_id", F.posexplode("extraction.interactions").alias("interaction_idx", "i"))
    return each.select("record_id", "year", "cluster_id", "interaction_idx", "i.*").withColumn("co_herbs", F.array_join("co_herbs", "|"))


def validate_interaction(i: Column) -> Column:
    """JSN1: names of the rules that an interaction breaks: vocabularies, confidence from 0 to 1, a quote of ten characters, a list of co-herbs."""
    checks = {k: F.coalesce(i[k].isin(*v), F.lit(False)) for k, v in VOCABULARIES.items()}
    checks["confidence"] = F.coalesce(i["confidence"].between(0.0, 1.0), F.lit(False))
    checks["evidence_quote"] = F.coalesce(F.length(F.trim(i["evidence_quote"])) >= 10, F.lit(False))
    checks["co_herbs"] = i["co_herbs"].isNotNull()
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))


def validate_json(df: DataFrame, column: str, schema: T.StructType = EXTRACTION) -> DataFrame:
    """JSN1: parsed value, whether it is valid, and all errors. Unknown fields are refused, as are missing ones."""
    known = schema.fieldNames()
    keys = F.json_object_keys(column)
    parsed = F.from_json(column, schema)
    own = F.when(keys.isNull(), F.array(F.lit("not an object"))).otherwise(
        F.concat(F.transform(F.array_except(keys, F.array(*map(F.lit, known))), lambda k: F.concat(F.lit("extra "), k)), F.transform(F.array_except(F.array(*map(F.lit, known)), keys), lambda k: F.concat(F.lit("missing "), k)))
    )
    inner = F.flatten(F.transform(F.coalesce(parsed["interactions"], F.array().cast(T.ArrayType(INTERACTION))), validate_interaction)) if "interactions" in known else F.array().cast("array<string>")
    return df.withColumn("parsed", parsed).withColumn("errors", F.concat(own, inner)).withColumn("valid", F.size("errors") == 0)


def strip_schema_keywords(schema: object, keywords: frozenset[str] = frozenset({"default", "format", "pattern", "minimum", "maximum", "minLength", "maxLength", "title"})) -> object:
    """JSN2: a JSON schema without the keywords that a strict mode refuses, at any depth; names of properties stay."""
    if isinstance(schema, dict):
        return {k: {n: strip_schema_keywords(s, keywords) for n, s in v.items()} if k == "properties" and isinstance(v, dict) else strip_schema_keywords(v, keywords) for k, v in schema.items() if k not in keywords}
    return [strip_schema_keywords(x, keywords) for x in schema] if isinstance(schema, list) else schema


def strip_schema_text(c: Column) -> Column:
    """JSN2 on a column of schemas as JSON texts; nulls stay, other texts than JSON raise."""

    def run(schemas: pd.Series) -> pd.Series:
        return schemas.map(lambda s: json.dumps(strip_schema_keywords(json.loads(s)), ensure_ascii=False), na_action="ignore")

    return F.pandas_udf(run, T.StringType())(c)


def interaction_class(drug_known: Column, target_known: Column) -> Column:
    """CLS1"""
    return F.when(drug_known & target_known, "complete").when(drug_known, "herb_drug_no_target").when(target_known, "herb_target_no_drug").otherwise("fragmentary")


def mechanism_group(c: Column) -> Column:
    """CLS2: how the drug's exposure (PK) or its effect (PD) is concerned."""
    pk = VOCABULARIES["mechanism"][:9]
    return F.when(c.isin(*pk), "PK").when(c.isin(*VOCABULARIES["mechanism"][9:16]), "PD").otherwise("other")


def confidence_bucket(c: Column, bounds: Sequence[float] = (0.5, 0.7, 0.9)) -> Column:
    """AGG34: half-open bins."""
    out = F.lit(f">={bounds[-1]}")
    for lo, hi in reversed(list(zip([None, *bounds[:-1]], bounds, strict=True))):
        out = F.when(c < hi, f"<{hi}" if lo is None else f"[{lo},{hi})").otherwise(out)
    return F.when(c.isNotNull(), out)


def gold_triples(df: DataFrame, cls: str, specific: str, fields: Sequence[str]) -> DataFrame:
    """FLT14"""
    out = df.filter((F.col(cls) == "complete") & F.col(specific))
    return out.dropna(subset=list(fields))


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """MTH7"""
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def model_summary(results: DataFrame, model: str, price_in: float, price_out: float) -> DataFrame:
    """AGG35"""
    return results.groupBy(model).agg(
        F.count(F.lit(1)).alias("n"), (100.0 * F.count_if("ok") / F.count(F.lit(1))).alias("pct_valid"), F.count_if("contains_hdi").alias("n_positive"), F.sum("n_interactions").alias("n_interactions"),
        F.avg("elapsed_s").alias("mean_elapsed_s"), F.sum(cost(F.col("input_tokens"), F.col("output_tokens"), price_in, price_out)).alias("cost"),
    )


def profile(df: DataFrame) -> DataFrame:
    """DQ1: per column its type, filled percent and distinct values, in one pass; lists and maps are compared as text."""
    cols = df.columns
    flat = df.select(*[F.to_json(F.struct(c)).alias(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c) for c in cols])
    kept = {c: df[c].isNotNull() for c in cols}
    both = df.select(*[kept[c].alias(f"_f{i}") for i, c in enumerate(cols)], *[flat_c.alias(f"_v{i}") for i, flat_c in enumerate(F.to_json(F.struct(c)) if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c) for c in cols)])
    one = both.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f"_f{i}").alias(f"f{i}") for i in range(len(cols))], *[F.countDistinct(F.when(F.col(f"_f{i}"), F.col(f"_v{i}"))).alias(f"d{i}") for i in range(len(cols))])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"), (100.0 * F.col(f"f{i}") / F.nullif(F.col("n"), F.lit(0))).alias("pct_filled"), F.col(f"d{i}").alias("n_unique")) for i, c in enumerate(cols)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def find_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """SRC13: the first column, whatever its case, that a list of candidates names."""
    names = {c.lower(): c for c in df.columns}
    return next((names[c.lower()] for c in candidates if c.lower() in names), None)


def columns_like(df: DataFrame, patterns: Sequence[str]) -> list[str]:
    """DQ2"""
    return [c for c in df.columns if any(p.lower() in c.lower() for p in patterns)]


def length_profile(df: DataFrame, text: str) -> DataFrame:
    """DQ4: quantiles of characters and words."""
    x = df.select(F.length(text).alias("chars"), F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+"), 0)).alias("words"))
    q = [F.percentile(c, F.lit(v)).alias(f"{c}_{n}") for c in ("chars", "words") for n, v in (("median", 0.5), ("p95", 0.95), ("p99", 0.99))]
    return x.agg(*q, F.max("chars").cast("long").alias("chars_max"), F.max("words").cast("long").alias("words_max"))


def id_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """DQ7, SET2: distinct keys in both, in the first and in the second only."""
    x, y = (d.filter(F.col(key).isNotNull()).select(key).distinct().withColumn(n, F.lit(True)) for d, n in ((a, "in_a"), (b, "in_b")))
    j = x.join(y, key, "full_outer")
    return j.agg(F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("both"), F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"))

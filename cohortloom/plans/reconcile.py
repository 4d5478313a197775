"""From sample sheets, draws, diagnoses and patients to one record per sample.

Hand corrections come in as override tables. Every step labels rows instead of splitting and
stacking, so one pass carries all samples and the parts stay visible for audit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import predicates
from cohortloom.functions.columns import common_columns
from cohortloom.functions.strings import clean_id
from cohortloom.operators import dedup, joins, summaries
from cohortloom.operators.ordering import row_index
from cohortloom.operators.stats.anova import anova_oneway
from cohortloom.operators.stats.tukey import tukey_hsd
from cohortloom.session import materialise

# Ages outside these limits are entry errors.
AGE_MIN, AGE_MAX = 1, 150


def stack_sheets(sheets: Mapping[str, DataFrame], platform: str = "Platform", id_col: str = "PIDN",
                 drop_pattern: str | None = None, exclude: str | None = "^Status$") -> DataFrame:
    """Stack platform sheets over their shared columns, clean the ids, and drop ids that match
    ``drop_pattern`` (control material)."""
    names = common_columns(*sheets.values(), exclude=exclude)
    stacked = dedup.stack({k: d.select(*names) for k, d in sheets.items()}, platform)
    if drop_pattern:
        stacked = stacked.where(~predicates.matches(F.col(id_col), drop_pattern))
    return stacked.withColumn(id_col, clean_id(F.col(id_col)))


def age_facts(draws: DataFrame, key: str, age: str, lo: float = AGE_MIN, hi: float = AGE_MAX) -> DataFrame:
    """Per person: whether any draw has an impossible age, how many distinct ages there are (a missing
    age is one, and is never an error), and the greatest."""
    bad = F.coalesce((F.col(age) < lo) | (F.col(age) > hi), F.lit(False))
    return draws.groupBy(key).agg(
        F.max(bad).alias("_bad"), F.max(age).alias("_only"),
        (F.count_distinct(age) + F.max(F.col(age).isNull().cast("int"))).alias("_ages"))


def diagnosis_facts(diagnosis: DataFrame, overrides: DataFrame, key: str, label: str) -> DataFrame:
    """Per person: the label where one row gives it, the override where several do."""
    per_key = diagnosis.groupBy(key).agg(F.count("*").alias("_n"), F.max(label).alias("_label"))
    given = overrides.select(key, F.col(label).alias("_override"))
    return joins.attach(per_key, given, key).select(
        key, F.lit(True).alias("_diagnosed"), F.when(F.col("_n") == 1, F.col("_label")).otherwise(F.col("_override")).alias(label))


def assign_ages(samples: DataFrame, draws: DataFrame, key: str = "PIDN", age: str = "AgeAtDraw",
                order_by: Sequence = ("Batch", "Slide"), lo: float = AGE_MIN, hi: float = AGE_MAX,
                carry: Sequence[DataFrame] = ()) -> DataFrame:
    """Add the age of every sample and ``age_status``.

    no_draw: no draw of this person. invalid: some draw has an impossible age, so none is used.
    one: a single distinct age. matched: as many samples as distinct ages, paired in order.
    unmatched: counts differ; the age stays NULL for an override.

    Facts per person are put together first, with further person tables to ``carry`` along, so
    the samples are joined once.
    """
    people = samples.groupBy(key).agg(F.count("*").alias("_samples"))
    facts = age_facts(draws, key, age, lo, hi)
    for table in (facts, *carry):
        people = joins.attach(people, table, key)
    status = (F.when(F.col("_bad").isNull(), "no_draw").when(F.col("_bad"), "invalid")
              .when(F.col("_ages") == 1, "one").when(F.col("_ages") == F.col("_samples"), "matched")
              .otherwise("unmatched"))
    people = materialise(people.withColumn("age_status", status), "people")
    joined = joins.attach(samples, people, key)
    extra = [c for t in carry for c in t.columns if c != key]
    keep = [*samples.columns, *extra, "age_status"]
    rest = joined.where("age_status <> 'matched'").select(
        *keep, F.when(F.col("age_status") == "one", F.col("_only")).alias(age))
    # Only people with several ages in equal number need an order on either side.
    several = people.where("age_status = 'matched'")
    top = several.agg(F.max("_samples").alias("largest"), F.sum("_samples").alias("total")).first()
    sizes = (top["largest"] or 0, top["total"] or 0)
    placed = row_index(joined.where("age_status = 'matched'").select(*keep), list(order_by), [key], "_k", sizes=sizes)
    distinct = joins.keep_in(draws.select(key, age).distinct(), several, key)
    values = row_index(distinct, [age], [key], "_k", sizes=sizes)
    return rest.unionByName(joins.attach(placed, values, [key, "_k"]).drop("_k"))


def override_ages(records: DataFrame, ages: DataFrame, key: str = "Slide", age: str = "AgeAtDraw") -> DataFrame:
    """Give samples whose ages could not be matched the age that was looked up by hand, and the status ``override``.

    ``ages``: (key, age), one row per sample; rows of other samples and without an age change nothing.
    """
    given = ages.select(key, F.col(age).alias("_given")).where(F.col("_given").isNotNull()).groupBy(key).agg(F.max("_given").alias("_given"))
    open_row = (F.col("age_status") == "unmatched") & F.col("_given").isNotNull()
    return joins.attach(records, given, key).withColumns({
        age: F.when(open_row, F.col("_given")).otherwise(F.col(age)),
        "age_status": F.when(open_row, "override").otherwise(F.col("age_status"))}).drop("_given")


def assign_diagnosis(samples: DataFrame, diagnosis: DataFrame, overrides: DataFrame, key: str = "PIDN",
                     label: str = "Diagnosis", otherwise: str = "Unknown") -> DataFrame:
    """The person's diagnosis where one row gives it, the override where several do, else ``otherwise``."""
    return _label(joins.attach(samples, diagnosis_facts(diagnosis, overrides, key, label), key), label, "_diagnosed", otherwise)


def assign_sex(samples: DataFrame, patients: DataFrame, key: str = "PIDN", sex: str = "Gender",
               otherwise: str = "UNKNOWN") -> DataFrame:
    """The patient table's sex, or ``otherwise`` for people it lacks."""
    return _label(joins.attach(samples, _sex_facts(patients, key, sex), key), sex, "_registered", otherwise)


def _sex_facts(patients: DataFrame, key: str, sex: str) -> DataFrame:
    return patients.select(key, sex).distinct().withColumn("_registered", F.lit(True))


def _label(df: DataFrame, col: str, found: str, otherwise: str) -> DataFrame:
    return df.withColumn(col, F.when(F.col(found), F.col(col)).otherwise(otherwise)).drop(found)


def sample_records(samples: DataFrame, draws: DataFrame, diagnosis: DataFrame, overrides: DataFrame,
                   patients: DataFrame, key: str = "PIDN") -> DataFrame:
    """One row per sample with age, age status, diagnosis and sex."""
    carry = [diagnosis_facts(diagnosis, overrides, key, "Diagnosis"), _sex_facts(patients, key, "Gender")]
    aged = assign_ages(samples, draws, key, carry=carry)
    return _label(_label(aged, "Diagnosis", "_diagnosed", "Unknown"), "Gender", "_registered", "UNKNOWN")


def people_of(records: DataFrame, key: str = "PIDN") -> DataFrame:
    """One row per person: Diagnosis and Gender of the first sample by batch and slide, and the greatest age (missing
    if any of the person's ages is)."""
    people = records.groupBy(key).agg(
        F.min(F.struct(F.col("Batch").isNull().alias("_nb"), "Batch", F.col("Slide").isNull().alias("_ns"), "Slide", "Diagnosis", "Gender"))
        .alias("_first"),
        summaries.strict(F.max, F.col("AgeAtDraw")).alias("age"))
    return people.select(key, "_first.Diagnosis", "_first.Gender", "age")


def diagnosis_report(records: DataFrame, levels: Sequence[str], key: str = "PIDN", keep_empty: bool = False) -> DataFrame:
    """Per diagnosis: people per sex, total, mean of each person's greatest age (missing if any age
    is), and people of unknown age."""
    return summaries.group_summary(people_of(records, key), "Diagnosis", "Gender", "age", levels, keep_empty)


def positive_report(records: DataFrame, mutations: DataFrame, levels: Sequence[str], key: str = "PIDN",
                    mutation: str = "Mutation", positive: str = "Positive") -> DataFrame:
    """``diagnosis_report`` of the people with a positive sequencing result."""
    carriers = mutations.where(F.col(mutation) == positive).select(key)
    return diagnosis_report(joins.keep_in(records, carriers, key), levels, key)


def diagnosis_models(records: DataFrame, include: str, response: str = "age", key: str = "PIDN") -> tuple[DataFrame, DataFrame]:
    """(analysis of variance, all-pairs comparison) of a person's age or coded sex by diagnosis.

    Only diagnoses that match the pattern ``include`` and people of known age count; labels are compared without
    ``/ `` and in upper case, so spellings of one diagnosis fall together. Sex is coded by its level's place.
    """
    people = people_of(records, key)
    known = people.where(predicates.matches(F.col("Diagnosis"), include) & F.col("age").isNotNull())
    tidy = known.withColumn("Diagnosis", F.upper(F.regexp_replace("Diagnosis", "/ ", "")))
    if response != "age":
        levels = [row[0] for row in tidy.select(response).distinct().dropna().orderBy(response).collect()]
        place = F.element_at(F.create_map(*[x for i, v in enumerate(levels) for x in (F.lit(v), F.lit(i + 1.0))]), F.col(response)) if levels else F.lit(None)
        tidy = tidy.withColumn(response, place.cast("double"))
    tidy = materialise(tidy, "people")
    return anova_oneway(tidy, response, "Diagnosis"), tukey_hsd(tidy, response, "Diagnosis")

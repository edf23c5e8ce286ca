"""Slugs, versions, references, handles and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill.functions import as_column, bind
from glossmill.functions.numbers import parse_prefix_integer

# First rule whose fragment occurs in the lower-cased name wins.
FAMILY_RULES = [
    ("byt5", ["byt5", "byte"]),
    ("t5", ["t5", "mt5", "flan"]),
    ("nllb", ["nllb"]),
    ("qwen", ["qwen"]),
    ("gemma", ["gemma"]),
]
PREPROCESSING_RULES = [
    ("consonantal", ["consonantal", "skeleton", "consonant"]),
    ("annotated", ["annotated", "enriched"]),
    ("lexicon", ["lexicon", "lex"]),
]
TASK_PREFIX_FAMILIES = ["t5", "byt5", "mt5", "flan-t5", "long-t5"]


def slugify(c: Column | str, trim: bool = True) -> Column:
    """Lower case, every run of other characters a dash; ``trim`` drops one dash at each end."""
    slug = F.regexp_replace(F.lower(as_column(c)), "[^a-z0-9]+", "-")
    return F.regexp_replace(slug, "^-|-$", "") if trim else slug


def _two_digits(number: Column) -> Column:
    text = number.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def versioned_slug(
    name: Column | str,
    version: Column | str,
    strategy: Column | str,
    at: Column | str,
    separator: str = "-",
    experiment_separator: str = "-",
) -> Column:
    """Slug with its version: ``-v1-0-0``, ``-exp-05``, ``-20240131-235959`` or nothing (overwrite).

    ``at`` is the time of the timestamp strategy; it is always passed in, so results repeat.
    """
    base = slugify(name)
    text = as_column(version).cast("string")
    kind = as_column(strategy)
    number = F.coalesce(F.nullif(parse_prefix_integer(text), F.lit(0)), F.lit(1))
    suffix = (
        F.when(kind == "timestamp", F.date_format(as_column(at), "yyyyMMdd-HHmmss"))
        .when(kind == "experiment", F.concat(F.lit(f"exp{experiment_separator}"), _two_digits(number)))
        .otherwise(F.concat(F.lit("v"), F.replace(text, F.lit("."), F.lit("-"))))
    )
    return F.when(kind == "overwrite", base).otherwise(F.concat(base, F.lit(separator), suffix))


def bump_version(current: Column | str, strategy: Column | str, part: str = "patch") -> Column:
    """Next version. Dotted versions raise one part and reset the lower ones; others count up by 1."""
    text = as_column(current).cast("string")

    def piece(position: int, missing: int) -> Column:
        raw = F.get(F.split(text, r"\."), F.lit(position))
        number = F.when(F.trim(raw) == "", F.lit(0)).otherwise(raw.try_cast("bigint"))
        return F.when(raw.isNull(), F.lit(missing)).otherwise(number)

    major, minor, patch = piece(0, 1), piece(1, 0), piece(2, 0)
    raised = {
        "major": [major + 1, F.lit(0), F.lit(0)],
        "minor": [major, minor + 1, F.lit(0)],
        "patch": [major, minor, patch + 1],
    }[part]
    dotted = F.concat(raised[0].cast("string"), F.lit("."), raised[1].cast("string"), F.lit("."), raised[2].cast("string"))
    counted = (F.coalesce(parse_prefix_integer(text), F.lit(0)) + 1).cast("string")
    return F.when(as_column(strategy) == "semver", dotted).otherwise(counted)


def parse_ref(c: Column | str) -> Column:
    """``raw:2`` as a struct (name, version); the version is NULL where none is given."""
    parts = F.split(as_column(c), ":")
    return F.struct(
        F.get(parts, F.lit(0)).alias("name"),
        parse_prefix_integer(F.get(parts, F.lit(1))).alias("version"),
    )


def format_ref(name: Column | str, version: Column | str) -> Column:
    number = F.nullif(as_column(version).cast("bigint"), F.lit(0))
    suffix = F.concat(F.lit(":"), number.cast("string"))
    return F.concat(as_column(name), F.coalesce(suffix, F.lit("")))


def parse_handle(c: Column | str, lenient: bool = False) -> Column:
    """``owner/model/framework/variation[/version]`` as a struct, NULL where the form is wrong.

    ``lenient`` also takes ``owner/model`` and fills in ``transformers/default``.
    """
    text = as_column(c)
    parts = F.split(text, "/")

    def part(position: int) -> Column:
        return F.get(parts, F.lit(position))

    if not lenient:
        strict = F.struct(
            part(0).alias("owner"),
            part(1).alias("model"),
            part(2).alias("framework"),
            part(3).alias("variation"),
            part(4).alias("version"),
        )
        return F.when(F.size(parts).between(4, 5), strict)
    whole = F.size(parts) >= 4
    framework = F.when(whole, part(2)).otherwise(F.lit("transformers"))
    variation = F.when(whole, part(3)).otherwise(F.lit("default"))
    handle = F.when(whole, text).otherwise(F.concat_ws("/", part(0), part(1), framework, variation))
    loose = F.struct(
        part(0).alias("owner"),
        part(1).alias("model"),
        framework.alias("framework"),
        variation.alias("variation"),
        handle.alias("full_handle"),
    )
    return F.when(F.size(parts) >= 2, loose)


def extract_version(c: Column | str, default: str = "1.0.0") -> Column:
    """The first ``1.0.10`` or ``v1-0-10`` in a name, as a dotted version."""
    text = as_column(c)
    pattern = r"v?(\d+)[.-](\d+)[.-](\d+)"
    found = F.concat_ws(".", *[F.regexp_extract(text, pattern, group) for group in (1, 2, 3)])
    return F.when(text.rlike(pattern), found).otherwise(F.lit(default))


def detect_by_rules(c: Column | str, rules: list[tuple[str, list[str]]]) -> Column:
    """Label of the first rule with a fragment that occurs in the lower-cased text, else NULL."""
    text = F.lower(as_column(c))
    label = F.lit(None).cast("string")
    for name, fragments in reversed(rules):
        hit = F.lit(False)
        for fragment in fragments:
            hit = hit | text.contains(fragment)
        label = F.when(hit, F.lit(name)).otherwise(label)
    return label


def needs_task_prefix(c: Column | str) -> Column:
    return detect_by_rules(c, [("yes", TASK_PREFIX_FAMILIES)]).isNotNull()


def url_parts(c: Column | str) -> Column:
    """Scheme, host, path, non-empty path parts, query and fragment of a URL."""
    text = F.trim(as_column(c))
    whole = F.when(text.startswith("http"), text).otherwise(F.concat(F.lit("https://"), text))

    def parsed(url: Column) -> Column:
        path = F.try_parse_url(url, F.lit("PATH"))
        return F.struct(
            F.try_parse_url(url, F.lit("PROTOCOL")).alias("scheme"),
            F.lower(F.try_parse_url(url, F.lit("HOST"))).alias("host"),
            path.alias("path"),
            F.filter(F.split(path, "/"), lambda part: part != "").alias("parts"),
            F.try_parse_url(url, F.lit("QUERY")).alias("query"),
            F.try_parse_url(url, F.lit("REF")).alias("fragment"),
        )

    return bind(whole, parsed)


def parse_code_url(c: Column | str, host: str = "kaggle.com", marker: str = "code") -> Column:
    """``https://host/code/owner/name?scriptVersionId=1`` as (slug, version_id).

    A bare ``owner/name`` is taken as the slug; anything else, and other hosts, give NULL.
    """
    text = as_column(c)

    def from_url(url: Column) -> Column:
        parts = url["parts"]
        version = F.regexp_extract(F.concat(F.lit("&"), url["query"]), "&scriptVersionId=([^&]*)", 1)
        good = url["host"].contains(host) & (F.size(parts) >= 3) & (F.get(parts, F.lit(0)) == marker)
        return F.when(
            good,
            F.struct(
                F.concat_ws("/", F.get(parts, F.lit(1)), F.get(parts, F.lit(2))).alias("slug"),
                F.nullif(version, F.lit("")).alias("version_id"),
            ),
        )

    bare = F.struct(text.alias("slug"), F.lit(None).cast("string").alias("version_id"))
    return (
        F.when(text.contains(f"{host}/{marker}/"), bind(url_parts(text), from_url))
        .when(text.contains("/") & ~text.contains(" "), bare)
    )


def classify_source(c: Column | str, root: str = "/kaggle/input") -> Column:
    """Kind, name and read path of a data source: ``owner/set``, a bare competition name, or a path."""
    text = as_column(c)
    parts = F.split(text, "/")
    dataset = text.contains("/") & ~text.startswith("/") & (F.size(parts) == 2)
    bare = ~text.contains("/")
    last = F.get(F.filter(parts, lambda part: part != ""), F.size(F.filter(parts, lambda part: part != "")) - 1)

    def row(kind: str, name: Column, path: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), path.alias("path"))

    return (
        F.when(dataset, row("dataset", text, F.concat(F.lit(f"{root}/"), F.get(parts, F.lit(1)), F.lit("/*.csv"))))
        .when(bare, row("competition", text, F.concat(F.lit(f"{root}/"), text, F.lit("/*.csv"))))
        .otherwise(row("local", last, text))
    )

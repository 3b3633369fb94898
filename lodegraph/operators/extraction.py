"""Terms and relations out of pages: commands, prose, alternatives."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ALTERNATIVE_CUES, REQUIREMENT_CUES, canon_token, sentences, snippet, tokens


class Command(NamedTuple):
    """A command that names packages: its programs, the verbs that may follow, whether it takes several names."""

    extractor: str
    programs: tuple[str, ...]
    verbs: tuple[str, ...]
    several: bool


# What the commands are called.
COMMANDS = (
    Command("apt-install", ("apt", "apt-get"), ("install",), True),
    Command("apk-add", ("apk",), ("add",), True),
    Command("brew-install", ("brew",), ("install",), True),
    Command("composer-require", ("composer",), ("require",), False),
    Command("dnf-yum-install", ("dnf", "yum"), ("install",), True),
    Command("docker-run", ("docker",), ("run", "pull"), False),
    Command("npm-install", ("npm",), ("install", "i"), False),
    Command("pacman-install", ("pacman",), ("-s", "-sy", "-syu"), True),
    Command("pip-install", ("pip", "pip3"), ("install",), False),
    Command("systemctl-unit", ("systemctl",), ("enable", "restart", "start", "status"), False),
    Command("zypper-install", ("zypper",), ("install",), True),
)
# What stands before a name in declarations of extensions and build options.
DECLARATIONS = (
    ("configure-enable", "--enable-"),
    ("configure-with", "--with-"),
    ("ext-directive", "extension="),
)
IMAGE_KEY, PHP_WORD = "image:", r"^php[0-9.]*-[a-z][a-z0-9_]{1,20}$"
CERTAIN, LIKELY = 0.95, 0.85
NAME = r"^[A-Za-z0-9_@][A-Za-z0-9_.+:@/\[\]-]*$"


def command_lines(code: Column) -> Column:
    """Words of each simple command: lines cut at ``&&``, ``|`` and ``;``, and at blanks."""
    joined = F.regexp_replace(F.regexp_replace(code, r"\\\r?\n", " "), r"\s*=\s*", "=")
    lines = F.split(joined, r"[\r\n;|]+|&&")
    words = F.transform(lines, lambda x: F.filter(F.split(F.trim(x), r"[\s,]+"), lambda w: w != ""))
    return F.filter(words, lambda w: F.size(w) > 0)


def _named(words: Column, command: Command) -> Column:
    """Names that a simple command gives to ``command``: after program and verb, without options, up to what is none.

    A name may carry a version after ``=``; it is the last one then.
    """
    low = F.transform(words, F.lower)
    found = F.array(*[F.array_position(low, F.lit(p)) for p in command.programs])
    at = F.array_max(found).cast("int")
    options = [v for v in command.verbs if v.startswith("-")]
    after = F.slice(words, at + 1, F.size(words))
    after = F.filter(after, lambda w: ~w.startswith("-") | F.lower(w).isin(*options))
    names = F.slice(after, 2, F.size(words))
    versioned = F.array_position(F.transform(names, lambda w: F.contains(w, F.lit("="))), F.lit(True)).cast("int")
    names = F.when(versioned > 0, F.slice(names, 1, versioned)).otherwise(names)
    names = F.transform(names, lambda w: F.substring_index(w, "=", 1))
    wrong = F.transform(names, lambda w: ~w.rlike(NAME))
    ends = F.array_position(wrong, F.lit(True)).cast("int")
    names = F.when(ends > 0, F.slice(names, 1, ends - 1)).otherwise(names)
    names = names if command.several else F.slice(names, 1, 1)
    fits = (at > 0) & F.coalesce(F.lower(F.get(after, F.lit(0))).isin(*command.verbs), F.lit(False))
    return F.when(fits, names).otherwise(F.array().cast("array<string>"))


def _all_named(lines: Column, command: Command) -> Column:
    return F.flatten(F.transform(lines, lambda words: _named(words, command)))


def _after(words: Column, before: str) -> Column:
    """The names that follow ``before`` in words that begin with it."""
    found = F.filter(words, lambda w: F.lower(w).startswith(before))
    return F.transform(found, lambda w: F.regexp_extract(F.substring(w, len(before) + 1, 25), r"^[A-Za-z0-9_-]{2,}", 0))


def from_code(rows: DataFrame, key: str, code: Column) -> DataFrame:
    """key, extractor, context, confidence, term: one row per package named by a command or a declaration."""
    none = F.array().cast("array<string>")
    lines, words = F.col("_lines"), F.flatten(F.col("_lines"))
    images = F.transform(
        F.filter(lines, lambda w: F.lower(F.get(w, F.lit(0))) == IMAGE_KEY),
        lambda w: F.btrim(F.coalesce(F.get(w, F.lit(1)), F.lit("")), F.lit("\"'")),
    )
    php = F.transform(F.filter(F.transform(words, F.lower), lambda w: w.rlike(PHP_WORD)), lambda w: F.substring_index(w, "-", -1))
    found = [(c.extractor, "install-cmd", CERTAIN, _all_named(lines, c)) for c in COMMANDS]
    found.append(("docker-compose-image", "install-cmd", CERTAIN, images))
    found.append(("php-ext-dash", "package-list", LIKELY, php))
    found += [(extractor, "package-list", LIKELY, _after(words, before)) for extractor, before in DECLARATIONS]
    mentions = [F.transform(F.coalesce(names, none), _mention(*about)) for *about, names in found]
    cut = rows.select(key, command_lines(code).alias("_lines"))
    out = cut.select(key, F.explode(F.concat(*mentions)).alias("m")).select(key, "m.*")
    return out.withColumn("term", canon_token(F.col("raw"))).where(F.col("term").isNotNull()).drop("raw")


def _mention(name: str, context: str, confidence: float):
    return lambda t: F.struct(
        F.lit(name).alias("extractor"),
        F.lit(context).alias("context"),
        F.lit(confidence).alias("confidence"),
        t.alias("raw"),
    )


def _cut(rows: DataFrame, key: str, text: Column, most: int) -> DataFrame:
    """key, sentence (its number), s: sentences of 8 to ``most`` characters.

    An outer explode, here and below: the plain one lets the optimizer repeat what it explodes in filters below.
    """
    cut = rows.select(key, F.posexplode_outer(sentences(text)).alias("sentence", "s"))
    return cut.where(F.length("s").between(8, most))


def _known(text: Column, names: list[str]) -> Column:
    """Distinct tokens that are among ``names``, in their order."""
    return F.array_distinct(F.filter(tokens(text), lambda t: t.isin(*names)))


def from_prose(rows: DataFrame, key: str, text: Column, names: list[str]) -> DataFrame:
    """key, sentence (its number), term, context, confidence: lexicon terms by sentence of 8 to 600 characters.

    Tokens are looked up in the lexicon; cues are looked for where a term was found.
    """
    held = _cut(rows, key, text, 600).select(key, "sentence", "s", F.explode_outer(_known(F.col("s"), names)).alias("term"))
    cue = F.col("s").rlike(REQUIREMENT_CUES)
    return held.where("term is not null").select(
        key,
        "sentence",
        F.when(cue, "requirements-list").otherwise("prose").alias("context"),
        F.when(cue, 0.6).otherwise(0.25).alias("confidence"),
        "term",
    )


def alternatives(rows: DataFrame, key: str, text: Column, names: list[str]) -> DataFrame:
    """key, sentence, a, b (a < b): pairs of two to four lexicon terms in a sentence with a cue of choice.

    Only texts that hold a cue are cut: a cue has no white space at its ends, so one in a sentence is one in its text.
    """
    from .graph import pairs

    cut = _cut(rows.where(text.rlike(ALTERNATIVE_CUES)), key, text, 400).where(F.col("s").rlike(ALTERNATIVE_CUES))
    held = cut.select(key, "sentence", F.explode_outer(F.array(F.sort_array(_known(F.col("s"), names)))).alias("t"))
    return pairs(held.where(F.size("t").between(2, 4)), F.col("t"), key, "sentence")


def best_mention(mentions: DataFrame, key: str, *order: str) -> DataFrame:
    """key, term with the highest confidence; the first by ``order`` on ties."""
    from .tables import first_wins

    return first_wins(mentions, [key, "term"], F.col("confidence").desc(), *[F.col(c) for c in order])


def snippet_of(text: Column, term: Column) -> Column:
    return snippet(text, F.instr(F.lower(text), term) - 1)

"""Text expressions: tokens, canonical names, sentences, containment, estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that never name a module.
STOP_TOKENS = (
    "y", "yes", "no", "the", "and", "or", "a", "an", "to", "in", "on", "of", "for", "with", "install",
    "update", "upgrade", "add", "remove", "get", "sudo", "apt", "dnf", "yum", "apk", "run", "pull", "enable",
    "start", "restart", "status", "service", "systemctl", "docker", "compose", "image", "latest", "true",
    "false", "null", "none", "all", "any", "default", "server", "client", "common", "core", "base", "full",
    "dev", "devel", "tools", "utils", "lib", "libs", "bin", "etc", "usr", "var", "opt", "tmp", "home", "root",
    "http", "https", "www", "com", "org", "net", "io", "sh", "bash", "zsh", "echo", "cd", "ls", "cp", "mv",
    "rm", "mkdir", "chmod", "chown", "curl_", "it", "is", "be", "are", "this", "that", "you", "your", "we",
    "our", "can", "will", "should", "may", "must", "if", "then", "else",
)
# Concepts too general to be a module.
GENERIC_CONCEPTS = (
    "guide", "tutorial", "article", "blog", "post", "page", "website", "introduction", "overview", "summary",
    "conclusion", "example", "examples", "step", "steps", "tips", "thing", "things", "way", "ways", "method",
    "methods", "process", "people", "time", "day", "year", "part", "type", "types", "kind", "number",
    "information", "content", "question", "questions", "answer", "answers", "problem", "solution", "result",
    "home", "about", "contact", "search", "menu", "comment", "comments", "share",
)
# Words of a question that carry no search intent, English and German.
QUESTION_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "am", "do", "does", "did", "doing",
    "can", "could", "will", "would", "shall", "should", "may", "might", "must", "have", "has", "had", "i",
    "me", "my", "we", "our", "you", "your", "it", "its", "they", "them", "he", "she", "his", "her", "this",
    "that", "these", "those", "what", "why", "how", "when", "where", "who", "whom", "which", "whose", "to",
    "of", "in", "on", "at", "for", "from", "with", "by", "as", "into", "about", "and", "or", "but", "not",
    "no", "if", "then", "than", "so", "there", "here", "any", "some", "get", "got", "make", "made", "please",
    "wie", "was", "warum", "wer", "wo", "wann", "welche", "welcher", "welches", "ich", "du", "ist", "sind",
    "war", "ein", "eine", "einen", "der", "die", "das", "den", "dem", "und", "oder", "nicht", "kann", "man",
    "mit", "für", "von", "auf", "zu", "im", "am", "mache", "machen",
)
# Words that do not count as entities by themselves.
ENTITY_STOPWORDS = (
    "the", "and", "for", "with", "that", "this", "from", "have", "has", "not", "but", "you", "your", "are",
    "was", "were", "will", "would", "should", "could", "what", "when", "where", "which", "while", "about",
    "into", "over", "after", "before", "been", "being", "does", "did", "doing", "how", "why", "who", "cant",
    "wont", "dont", "isnt", "help", "please", "need", "want", "trying", "error", "errors", "issue", "issues",
    "problem", "problems", "work", "works", "working", "start", "starts", "running", "run",
)
# Surfaces that are ambiguous in prose, and short ones that are not.
PROSE_UNSAFE = (
    "go", "spring", "bun", "deno", "paper", "forge", "fabric", "rust", "java", "monitoring", "backup",
    "backups", "accessibility", "firewall", "cron", "express", "flask", "dom", "zip", "gd", "xml", "npm",
    "pip", "git", "ts", "js", "vue", "next js", "site", "notebook", "torch", "sass", "vite",
)
PROSE_SAFE_SHORT = ("css", "php", "ssl", "sql", "api", "ssh", "jwt", "k8s", "tls")
# Cues of requirements, of alternatives and of technical topics.
REQUIREMENT_CUES = (
    r"(?i)\b(?:requires?|required|dependenc(?:y|ies)|prerequisites?|you(?:'ll| will)? need|must have|depends on|"
    r"install(?:ing|ation)?)\b"
)
ALTERNATIVE_CUES = (
    r"(?i)\b(?:or|either|alternatively|instead of|rather than|as an alternative|your choice of|one of)\b"
)
TECHNICAL_HINT = (
    r"(?i)\b(?:install|server|panel|daemon|config|nginx|apache|php|python|node|docker|database|sql|redis|api|ssl|"
    r"linux|ubuntu|debian|systemd|port|error \d{3}|\d{3} (?:error|bad gateway)|npm|pip|git|kubernetes|proxy|"
    r"firewall|deploy)\b"
)

MARK = "\u0001"


#: A token: from a letter, digit, ``_``, ``+`` or ``#`` to the last such sign of the run, dots and dashes between.
_EDGE = r"a-z0-9_+#\p{L}\p{N}"
TOKEN = rf"[{_EDGE}](?:[{_EDGE}.\-]*[{_EDGE}])"


def tokens(text: Column) -> Column:
    """Lower-cased words of letters, digits and ``_+#.-`` without edge dots or dashes, two characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def spaced(text: Column) -> Column:
    """The lower-cased text with one blank for what parts its tokens: cut at blanks, trimmed of ``-.``, two characters or more."""
    return F.regexp_replace(F.lower(text), rf"[^{_EDGE}.\-]+", " ")


def query_tokens(text: Column, most: int | None = 24) -> Column:
    """The first ``most`` distinct tokens (None: all): what a question may ask an index for."""
    found = F.array_distinct(tokens(text))
    return found if most is None else F.slice(found, 1, most)


def canon(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", "-")


def canon_token(raw: Column, alias: Column | None = None) -> Column:
    """Canonical module key of a package-like token, or null; ``alias``: a map from folded names to canonical ones."""
    t = F.regexp_replace(F.lower(F.trim(raw)), r"[=:@].*$", "")
    t = F.regexp_replace(t, r"\d+(\.\d+)*", "")
    t = F.regexp_replace(t, r"-(server|client|common|core|dev|devel|bin|doc|docs|data|utils?|tools?)$", "")
    t = F.regexp_replace(t, r"^lib", "")
    t = F.regexp_replace(t, r"[^a-z0-9+#._\-]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"^[-._]+|[-._]+$", ""), r"--+", "-")

    def checked(t: Column) -> Column:
        fine = F.length(t).between(2, 40) & ~t.isin(*STOP_TOKENS) & ~t.rlike(r"^\d+$")
        return F.when(fine, t if alias is None else F.coalesce(F.try_element_at(alias, t), t))

    # a name for the replaced text, which would else be spelled out at each check
    return F.get(F.transform(F.array(t), checked), F.lit(0))


def canon_concept(raw: Column) -> Column:
    """Canonical key of a proposed concept of one or two words, or null."""
    t = F.regexp_replace(F.lower(F.trim(raw)), r"^(the|a|an|your|my|how to|what is)\s+", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9+#\s._\-]", ""), r"\s+", "-")
    t = F.regexp_replace(t, r"^[-._]+|[-._]+$", "")
    generic = t.isin(*GENERIC_CONCEPTS) | F.replace(t, F.lit("-"), F.lit(" ")).isin(*GENERIC_CONCEPTS)
    fine = F.length(t).between(3, 40) & (F.size(F.split(t, "-")) <= 2) & ~generic & ~t.rlike(r"^\d+$")
    return F.when(fine, t)


def sentences(text: Column) -> Column:
    """Cut after ``.!?;:`` followed by white space, and at line ends; a mark stands in for look-behind."""
    marked = F.regexp_replace(F.regexp_replace(text, r"([.!?;:])\s+", f"$1{MARK}"), r"\n+", MARK)
    return F.split(marked, MARK)


def padded(text: Column) -> Column:
    """Lower-cased words between single blanks, so that a padded term is contained only at word boundaries."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "), F.lit(" "))


def loosened(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[\s._/\-]+", "")


def occurs_in(text: Column, name: Column) -> Column:
    """Does the name occur, whatever stands for blanks, dots, dashes and slashes?"""
    return (F.length(loosened(name)) >= 2) & F.contains(loosened(text), loosened(name))


def prose_safe(surface: Column) -> Column:
    s = F.lower(F.trim(surface))
    return (
        F.when(s.contains(" ") | s.contains("-"), True)
        .when(s.isin(*PROSE_UNSAFE), False)
        .when(s.isin(*PROSE_SAFE_SHORT), True)
        .otherwise(F.length(s) >= 4)
    )


def question_tokens(text: Column) -> Column:
    cleaned = F.regexp_replace(F.lower(text), r"[?!.,;:\"“”'’()\[\]{}]", " ")
    return F.filter(F.split(cleaned, r"\s+"), lambda t: F.length(t) > 0)


def content_tokens(text: Column) -> Column:
    """The question's tokens without question words; all of them if nothing else is left."""
    all_tokens = question_tokens(text)
    content = F.filter(all_tokens, lambda t: ~t.isin(*QUESTION_WORDS))
    return F.when(F.size(content) > 0, content).otherwise(all_tokens)


def entities(text: Column, most: int = 12, known: Column | None = None) -> Column:
    """Known names (if given), quoted spans, technology-like tokens, else content words: entities without a model."""
    quoted = F.transform(
        F.regexp_extract_all(text, F.lit("[\"'`]([^\"'`]{2,40})[\"'`]"), 1), lambda x: F.lower(F.trim(x))
    )
    words = F.regexp_extract_all(text, F.lit(r"\b([A-Za-z][A-Za-z0-9_.+#/\-]{2,30})\b"), 1)
    tech = F.transform(F.filter(words, lambda w: w.rlike(r"[0-9./\-]|^[a-z]+[A-Z]")), F.lower)
    parts = [quoted, tech] if known is None else [known, quoted, tech]
    found = F.filter(F.array_distinct(F.concat(*parts)), lambda x: F.length(x) > 0)
    rest = F.filter(
        F.split(F.lower(text), r"[^a-z0-9+#._\-]+"), lambda w: (F.length(w) >= 4) & ~w.isin(*ENTITY_STOPWORDS)
    )
    return F.slice(F.when(F.size(found) > 0, found).otherwise(F.array_distinct(rest)), 1, most)


def with_twins(names: Column, most: int = 12) -> Column:
    """Names of 2 to 60 characters, each followed by its canonical form, without repeats."""
    both = F.flatten(F.transform(names, lambda x: F.array(x, canon(x))))
    return F.slice(F.array_distinct(F.filter(both, lambda x: F.length(x).between(2, 60))), 1, most)


def session_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(3.6)).cast("long")


def snippet(text: Column, at: Column, length: int = 160) -> Column:
    """``length`` characters from 40 before the 0-based place, white space collapsed."""
    cut = F.substring(text, F.greatest(F.lit(1), at - 39).cast("int"), F.lit(length))
    return F.trim(F.regexp_replace(cut, r"\s+", " "))


def size_hint(name: Column) -> Column:
    """A model's parameter count named like ``7b`` or ``1.5B``, in upper case, or null."""
    found = F.regexp_extract(name, r"(?i)(\d+(?:\.\d+)?)\s*b\b", 1)
    return F.when(found != "", F.concat(found, F.lit("B")))


def prompt_tier(params: Column, tool_loop: Column) -> Column:
    b = F.try_to_number(F.regexp_replace(params, r"[^\d.]", ""), F.lit("999999.999")).cast("double")
    return (
        F.when(tool_loop, F.when(b >= 30, "standard").otherwise("compact"))
        .when(b.isNull(), "standard")
        .when(b < 8, "compact")
        .when(b < 30, "standard")
        .otherwise("max")
    )


# Words of a brief that name a medium, in order of precedence.
MEDIUM_WORDS = (
    ("tkinter", ("tkinter", "ttk", "tk.", "customtkinter")),
    ("qt", ("pyside", "pyqt", " qt ", "qml", "qwidget")),
    (
        "terminal",
        ("curses", "tui", "terminal ui", "ncurses", "textual", "blessed", "cli tool", "command line"),
    ),
    ("canvas", ("canvas", "game", "shader", "webgl", "particle", "sprite", "pygame", "render loop")),
    ("mobile", ("android", "ios", "swiftui", "flutter", "react native", "mobile app")),
    (
        "web",
        ("website", "landing page", "web app", "html", "css", "react", "vue", "svelte", "dashboard", "homepage"),
    ),
)


def medium_of(brief: Column) -> Column:
    low, out = F.lower(brief), None
    for medium, words in MEDIUM_WORDS:
        found = F.lit(False)
        for word in words:
            found = found | low.contains(word)
        out = F.when(found, medium) if out is None else out.when(found, medium)
    return out.otherwise("generic")


# What marks a source as unfinished.
PLACEHOLDERS = (
    r"(?i)lorem ipsum",
    r"\bTODO\b",
    r"\bFIXME\b",
    r"(?i)your text here",
    r"(?i)placeholder\s+(?:text|content|image|title|name)",
    r"(?i)>\s*placeholder\s*<",
    r"\bFeature [123]\b",
    r"\bItem [123]\b",
    r"(?i)replace ?me",
)


def has_placeholder(source: Column) -> Column:
    found = F.lit(False)
    for pattern in PLACEHOLDERS:
        found = found | source.rlike(pattern)
    return found


def line_of(source: Column, at: Column) -> Column:
    """1-based line of a 0-based offset."""
    before = F.substring(source, F.lit(1), at.cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1

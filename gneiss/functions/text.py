"""Scalar functions on text, paths and keys as column expressions; none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Identifier tokens: runs of anything but brackets, colon, equals, comma and white space. Fixed value; white space
#: is spelled out so that Java, RE2 and Python read the same tokens.
TOKEN = r"[^\[\](){}:=,\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: Fixed value: every character that is in no token.
SEPARATORS = "[](){}:=,\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: What ends a name in a statement, and the default of a statement without one.
NAME_END = r"[\[\]\{\}\(\):=,\s]"
NO_NAME = "Anon"


def tokens(text: Column) -> Column:
    """What ``TOKEN`` matches. Its separators become spaces and texts are split there, which takes a quarter of the time
    of a match for each token."""
    return F.array_remove(F.split(F.translate(text, SEPARATORS, " " * len(SEPARATORS)), " ", -1), "")


def first_tokens(text: Column, n: int) -> Column:
    """The first ``n`` tokens. Of a beginning that has more, all but the last are whole; otherwise the text is read on."""
    some = tokens(F.left(text, F.lit(16 * n)))
    return F.slice(F.when(F.size(some) > n, some).otherwise(tokens(text)), 1, n)


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def normalize_ws(s: Column) -> Column:
    return strip(F.regexp_replace(s, r"\s+", " "))


def theorem_name(statement: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(statement, rf"\S+\s+(\S+?){NAME_END}", 1), F.lit("")), F.lit(NO_NAME))


def data_point_name(path: Column) -> Column:
    """``.../repos/a/b.v`` -> ``a-b.v``; null for a path that is not under ``repos``."""
    return F.replace(F.nullif(F.regexp_extract(path, r"repos/(.*\.v)", 1), F.lit("")), F.lit("/"), F.lit("-"))


def from_repos(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"(repos/.*)$", 1), F.lit(""))


def rebase(path: Column, old: str, new: str) -> Column:
    return F.when(path.startswith(old), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)


def strip_parents(path: Column) -> Column:
    return F.regexp_replace(path, r"^(\.\./)+", "")


def same_file(a: Column, b: Column) -> Column:
    """Two paths mean one file if either, without leading parents, ends with the other."""
    x, y = strip_parents(a), strip_parents(b)
    return x.endswith(y) | y.endswith(x)


def proof_core(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("Proof."), F.lit("")), F.lit("Qed."), F.lit(""))


def proof_length(s: Column) -> Column:
    """Parts between full stops or semicolons that white space follows; at least 1."""
    return F.size(F.split(strip(proof_core(s)), r"[.;]\s+", -1))


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(proof_core(a), proof_core(b))


def goal_score(goal: Column, hyps: Column, normalise: bool = False) -> Column:
    """The least edit distance of a goal to a hypothesis, at most the goal's length."""
    best = F.aggregate(hyps, F.length(goal), lambda acc, h: F.when(F.abs(F.length(h) - F.length(goal)) > acc, acc).otherwise(F.least(acc, F.levenshtein(h, goal))))
    return F.try_divide(best.cast("double"), F.length(goal)) if normalise else best


def goals_score(scores: Column) -> Column:
    """The score of a list of goals from those of its goals, as an aggregate: the nearer its goals, the higher."""
    return -F.sum(scores)


def strip_owner(path: Column, owners: list[str]) -> Column:
    """Drops the first owner's name that, with a dash, begins the path."""
    out = path
    for name in reversed(owners):
        out = F.when(path.startswith(name + "-"), F.substring(path, len(name) + 2, 1 << 30)).otherwise(out)
    return out


def ends_of_path(path: Column) -> Column:
    """First and last part of a path."""
    parts = F.split(path, "/", -1)
    return F.concat_ws("/", F.element_at(parts, 1), F.element_at(parts, -1))


def strip_ansi(s: Column) -> Column:
    return F.regexp_replace(s, r"\x1b\[\d+m", "")


def tool_proof(stdout: Column) -> Column:
    """The proof that a synthesis tool printed, null if there is none."""
    plain = F.replace(strip_ansi(stdout), F.lit("only 1: "), F.lit(""))
    return F.nullif(F.regexp_extract(plain, r"synth with cache \((.*?)\)\.\r\nNo more (?:sub)?goals.", 1), F.lit(""))


def line_of(text: Column, offset: Column) -> Column:
    """0-based line of a character offset."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n", -1)) - 1


def column_of(text: Column, offset: Column) -> Column:
    return F.length(F.element_at(F.split(F.substring(text, F.lit(1), offset), "\n", -1), -1))


def text_between(text: Column, line1: Column, col1: Column, line2: Column, col2: Column) -> Column:
    """Text from a position (line, column) up to, not including, another one on the same or a later line."""
    lines = F.split(text, "\n", -1)
    first, last = F.get(lines, line1), F.get(lines, line2)
    middle = F.slice(lines, line1 + 2, F.greatest(line2 - line1 - 1, F.lit(0)))
    many = F.concat_ws("\n", F.substring(first, col1 + 1, F.length(first)), F.array_join(middle, "\n"), F.substring(last, F.lit(1), col2))
    two = F.concat_ws("\n", F.substring(first, col1 + 1, F.length(first)), F.substring(last, F.lit(1), col2))
    return F.when(line1 == line2, F.substring(first, col1 + 1, col2 - col1)).when(line2 == line1 + 1, two).otherwise(many)


def theorem_key(workspace: Column, path: Column, line: Column, column: Column) -> Column:
    return F.concat(workspace, F.lit("/"), path, F.lit("/"), line.cast("string"), F.lit("-"), column.cast("string"))


def md5_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("\n", *parts))


def goal_text(hyps: Column, goal: Column) -> Column:
    return F.concat(F.array_join(hyps, "\n"), F.lit("\n\n"), goal)


def goal_parts(text: Column) -> Column:
    """struct(hyps, goal); a goal without hypotheses comes back with one empty hypothesis, one with more than two
    parts as null."""
    parts = F.split(text, "\n\n", -1)
    one, two = F.size(parts) == 1, F.size(parts) == 2
    return F.when(one, F.struct(F.array().cast("array<string>").alias("hyps"), F.get(parts, F.lit(0)).alias("goal"))).when(
        two, F.struct(F.split(F.get(parts, F.lit(0)), "\n", -1).alias("hyps"), F.get(parts, F.lit(1)).alias("goal"))
    )


def definition_body(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, r"(?s):=\s*(.*?)\s*\.?\s*$", 1), F.lit(""))


def code_fence(s: Column) -> Column:
    inner = strip(F.regexp_replace(s, r"^```[^\n]*\n?|```$", ""))
    return F.when(s.startswith("```") & s.endswith("```"), inner).otherwise(s)


def owner_and_repo(remote: Column) -> Column:
    return F.nullif(F.regexp_extract(remote, r"[:/]([^/]*/[^/]*?)(\.git)?$", 1), F.lit(""))


# Dollars for a token that goes in and one that comes out.
PRICES = {"gpt-4o": (5e-6, 15e-6), "gpt-4o-mini": (0.15e-6, 0.6e-6), "o1-mini": (3e-6, 12e-6), "o1-preview": (15e-6, 60e-6)}


def cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, (a, b) in PRICES.items():
        out = F.when(model == name, tokens_in * F.lit(a) + tokens_out * F.lit(b)).otherwise(out)
    return out


def all_goals(focused: Column, stack: Column, shelf: Column) -> Column:
    return F.concat(focused, F.flatten(stack), shelf)


def goal_tokens(goal: Column) -> Column:
    """struct(hyps, goal) tokens of struct(hyps, goal): a hypothesis is split at every colon; its first part names
    things, the others are joined without a space; names are taken out of all tokens, repeats stay."""
    names = F.flatten(F.transform(goal["hyps"], lambda h: F.when(h.contains(":"), F.split(F.substring_index(h, ":", 1), ", ", -1)).otherwise(F.array().cast("array<string>"))))
    body = lambda h: F.when(h.contains(":"), F.array_join(F.slice(F.split(h, ":", -1), F.lit(2), F.size(F.split(h, ":", -1))), "")).otherwise(h)
    every = F.flatten(F.transform(goal["hyps"], lambda h: tokens(body(h))))
    # names in an array of their own, so that they are found once and not for each token
    keep = lambda a: F.transform(F.array(names), lambda found: F.filter(a, lambda t: ~F.array_contains(found, t)))[0]
    return F.struct(keep(every).alias("hyps"), keep(tokens(goal["goal"])).alias("goal"))


def position_of_section(ids: Column, tag: int) -> Column:
    """1 from the first occurrence of a tag on, 0 before it; all 0 without it (attention mask over a section)."""
    at = F.array_position(ids, F.lit(tag))
    return F.transform(ids, lambda _, i: F.when((at > 0) & (i + 1 >= at), 1).otherwise(0))


def last_characters(s: Column, n: int) -> Column:
    return F.right(s, F.lit(n))


def fill(template: str, *values: Column) -> Column:
    """A prompt with its values in place of ``%s``."""
    return F.format_string(template, *values)


def output_name(workspace: Column, relative: Column) -> Column:
    """The flat name of a file's output: workspace and path, with dashes for slashes."""
    return F.replace(F.concat_ws("/", workspace, relative), F.lit("/"), F.lit("-"))


def file_info(path: Column) -> Column:
    """struct(dp_name, file, workspace, repository) of a path below ``repos``."""
    inner = F.nullif(F.regexp_extract(path, r"(repos/.*)$", 1), F.lit(""))
    repository = F.nullif(F.regexp_extract(inner, r"^(repos/[^/]+)", 1), F.lit(""))
    return F.struct(data_point_name(path).alias("dp_name"), inner.alias("file"), repository.alias("workspace"), repository.alias("repository"))


def without_prefix(s: Column, prefix: str) -> Column:
    """The rest after a prefix that every row must have; a row without it fails the query."""
    checked = F.when(s.startswith(prefix), s).otherwise(F.raise_error(F.concat(F.lit(f"no prefix {prefix}: "), s)).cast("string"))
    return F.substring(checked, len(prefix) + 1, 1 << 30)

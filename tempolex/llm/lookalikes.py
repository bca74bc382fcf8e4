"""One form for texts that look alike: compatibility folding and script-aware repair of mixed-script tokens."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from ..session import free_name, stage
from .glyphs import LATIN_TO, TO_LATIN, compatible

_FOREIGN = re.compile(f"[{''.join(TO_LATIN)}]")
_BEYOND_LATIN = re.compile("[Ͱ-ԯ]")
_TOKEN = regex.compile(r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{M}'’]+")
_SCRIPT = regex.compile(r"(\p{Latin})|(\p{Greek})|(\p{Cyrillic})")
_SCRIPTS = ("Latin", "Greek", "Cyrillic")
#: The same in the JVM's expressions, for the vocabulary.
WORD = r"[\p{IsLatin}\p{IsGreek}\p{IsCyrillic}\p{M}'’]+"


def _script(ch: str) -> str | None:
    m = _SCRIPT.match(ch)
    return _SCRIPTS[m.lastindex - 1] if m else None


def scripts_of(token: str) -> tuple[Counter, Counter]:
    """Letters of each script, and those of them that have no twin in another script."""
    letters, own = Counter(), Counter()
    for ch in token:
        s = _script(ch)
        if s:
            letters[s] += 1
            twin = ch in TO_LATIN if s != "Latin" else any(ch in t for t in LATIN_TO.values())
            if not twin:
                own[s] += 1
    return letters, own


def in_script(token: str, script: str) -> str | None:
    """The token with all letters in `script`, or None if a letter has no twin there."""
    out = []
    for ch in token:
        s = _script(ch)
        if s in (None, script):
            out.append(ch)
            continue
        latin = TO_LATIN.get(ch) if s != "Latin" else ch
        twin = latin if script == "Latin" else LATIN_TO[script].get(latin) if latin else None
        if twin is None:
            return None
        out.append(twin)
    return "".join(out)


def repairs(token: str, around: str | None, foreign_twins: bool = False) -> list[str]:
    """Readings of a token in one script, the likeliest first.

    Mixed tokens: the dominant script is the one with most letters that have no twin elsewhere, then the script of the
    rest of the text, then the one with most letters. With `foreign_twins`, a token wholly of twins in a script foreign
    to its text (`around`) is read in the text's script.
    """
    letters, own = scripts_of(token)
    if len(letters) > 1:
        order = sorted(letters, key=lambda s: (-own[s], s != around, -letters[s], s))
    elif foreign_twins and around and letters and around not in letters and not own:
        order = [around]
    else:
        return []
    out = []
    for s in order:
        r = in_script(token, s)
        if r is not None and r != token and r not in out:
            out.append(r)
    return out


def doubtful(folded: str, foreign_twins: bool = False) -> list[tuple[str, list[str]]]:
    """Tokens of a folded text that may hold look-alike letters, with their readings."""
    if not _BEYOND_LATIN.search(folded):
        return []
    tokens = set(_TOKEN.findall(folded))
    total: Counter = Counter()
    for t in tokens:
        letters, own = scripts_of(t)
        if len(letters) == 1 and own:
            total.update(own)
    around = max(total, key=lambda s: (total[s], s)) if total else None
    if around is None and any(scripts_of(t)[0]["Latin"] for t in tokens):
        around = "Latin"
    return [(t, r) for t in sorted(tokens) if (r := repairs(t, around, foreign_twins))]


def _fold(foreign_twins: bool):
    def fold(texts: pd.Series) -> pd.DataFrame:
        folded, tokens = [], []
        for t in texts:
            f = None if t is None else compatible(t)
            folded.append(f)
            tokens.append(None if f is None else [{"token": a, "readings": b} for a, b in doubtful(f, foreign_twins)] or None)
        return pd.DataFrame({"folded": folded, "tokens": tokens})

    return F.pandas_udf(fold, _FOLDED)


def _substitute(folded: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    out = []
    for f, o, n in zip(folded, old, new):
        if f is None or o is None or not len(o):
            out.append(f)
        else:
            to = dict(zip(o, n))
            out.append(_TOKEN.sub(lambda m, to=to: to.get(m[0], m[0]), f))
    return pd.Series(out)


_FOLDED = "struct<folded:string,tokens:array<struct<token:string,readings:array<string>>>>"


def one_form(df: DataFrame, text_col: str, keys: list[str], foreign_twins: bool = False) -> DataFrame:
    """df with `form`, the text in the form that all texts of the same look share.

    First every text is folded: characters without a shape are removed, compatibility forms, widths and decomposed
    accents become their NFKC form, all blanks one blank, all line breaks one. Case, accents, digits, words and
    traditional characters stay. Then tokens that mix Latin, Greek and Cyrillic letters are read in their dominant
    script, with `foreign_twins` also those that consist of twins foreign to their text, provided that the reading is a word of the corpus: one of
    the single-script tokens of all of df's texts. Only doubtful tokens are looked up, their vocabulary counted with
    partial aggregation, so no word list is sent anywhere.

    Null texts have a null form, empty ones an empty form. All columns pass through, one named `form` is replaced.
    `keys` name columns that identify a row; rows with equal keys must hold equal texts, rows with null keys are only
    folded. The folded texts are written to the shared folder once and read twice.
    """
    fold = _fold(foreign_twins)
    both, folded, tokens, mapped = (free_name(df, c) for c in ("both", "folded", "tokens", "mapped"))
    base = stage(df.withColumn(both, fold(text_col)).withColumn(folded, F.col(f"{both}.folded")).withColumn(tokens, F.col(f"{both}.tokens")).drop(both), "folded")
    asked = base.where(F.col(tokens).isNotNull()).select(*keys, F.explode(tokens).alias("_t")).select(*keys, "_t.token", "_t.readings")
    wanted = asked.select("token", F.posexplode("readings").alias("at", "reading")).dropDuplicates()
    words = (
        base.where(F.col(folded).rlike(r"[\p{IsLatin}\p{IsGreek}\p{IsCyrillic}]"))
        .select(F.explode(F.array_distinct(F.regexp_extract_all(folded, F.lit(WORD), F.lit(0)))).alias("reading"))
        .dropDuplicates()
    )
    known = wanted.join(words, "reading", "left_semi").groupBy("token").agg(F.min_by("reading", "at").alias("reading"))
    mine = asked.select(*keys, "token").join(known, "token").groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("token", "reading"))).alias(mapped))
    plain = base.where(F.col(tokens).isNull()).withColumn("form", F.col(folded))
    mended = (
        base.where(F.col(tokens).isNotNull())
        .join(mine, keys, "left")
        .withColumn("form", F.pandas_udf(_substitute, "string")(folded, F.col(f"{mapped}.token"), F.col(f"{mapped}.reading")))
        .drop(mapped)
    )
    return plain.unionByName(mended).drop(folded, tokens)


def digested(forms: DataFrame, text_col: str) -> DataFrame:
    """forms with the 128-bit digests (MD5) of `form` and of the text in their places: narrow rows that compare like the texts."""
    digest = lambda c: F.unhex(F.md5(F.col(c).cast("binary")))
    return forms.withColumn("form", digest("form")).withColumn(text_col, digest(text_col))


def _usable(forms: DataFrame, id_col: str, group: list, text_col: str, step: str | None) -> DataFrame:
    some = " and ".join(f"{c} is not null" for c in [id_col, "form", text_col, *group] + ([step] if step else []))
    return forms.where(some).select(
        F.col(id_col).cast("bigint").alias("_id"), *group, *([F.col(step).alias("_step")] if step else []), F.col("form").alias("_f"), F.col(text_col).alias("_raw")
    ).dropDuplicates()


def alike_classes(forms: DataFrame, id_col: str, group: list, text_col: str, kind: str) -> DataFrame:
    """(unit_kind, unit_id, class_id, n_members, n_stored) of the rows whose form a row of the same group shares that is stored otherwise.

    One row per member, none per pair: n_members rows of the class, n_stored different texts among them. Rows with a
    null id, group column, form or text take no part, rows delivered again count once.
    """
    rows = _usable(forms, id_col, group, text_col, None)
    on = [*group, "_f"]
    classes = rows.groupBy(*on).agg(F.count_distinct("_id").alias("n_members"), F.count_distinct("_raw").alias("n_stored")).where("n_stored > 1")
    named = F.sha2(F.concat_ws("|", *(F.sha2(F.col(c).cast("string").cast("binary"), 256) for c in on[:-1]), F.sha2(F.col("_f").cast("binary"), 256)).cast("binary"), 256)
    return rows.select("_id", *on).dropDuplicates().join(classes, on).select(F.lit(kind).alias("unit_kind"), F.col("_id").alias("unit_id"), named.alias("class_id"), "n_members", "n_stored")


def alike_pairs(forms: DataFrame, id_col: str, group: list, text_col: str, kind: str, step: str | None = None, block: int = 1024) -> DataFrame:
    """Pairs (unit_kind, id_a, id_b), smaller id first, of equal form whose texts differ as stored.

    `group` names columns that must agree. With `step`, an integer column, the pair must also be consecutive in it.
    Rows with a null id, group column, form or text take no part, rows delivered again count once. Forms and texts are
    compared by what the columns hold, the texts or their digests (see digested()). Only members of classes with
    different texts meet, in blocks of about `block` rows of a class, so no class is joined in one task; identical
    stored texts pair with each other nowhere.
    """
    rows = _usable(forms, id_col, group, text_col, step)
    on = [*group, "_f"]
    renamed = {"_id": "_id2", "_raw": "_raw2"}
    if step:
        other = rows.withColumnsRenamed(renamed).withColumn("_step", F.col("_step") - 1)
        pairs = rows.join(other, [*on, "_step"]).where("_raw <> _raw2 and _id <> _id2")
    else:
        classes = rows.groupBy(*on).agg(F.ceil(F.count("*") / block).cast("int").alias("_n"), F.min("_raw").alias("_lo"), F.max("_raw").alias("_hi")).where("_lo <> _hi").drop("_lo", "_hi")
        met = rows.join(classes, on)
        left = met.withColumn("_b", F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int")).drop("_n")
        right = met.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n").withColumnsRenamed(renamed)
        pairs = left.join(right, [*on, "_b"]).where("_raw <> _raw2 and _id < _id2")
    return pairs.select(F.lit(kind).alias("unit_kind"), F.least("_id", "_id2").alias("id_a"), F.greatest("_id", "_id2").alias("id_b")).dropDuplicates()

"""Sentence boundaries by document-centred disambiguation, with corpus statistics as fallback."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import free_name
from .glyphs import INVISIBLE, token_key

# Fixed values, per script: marks that end a sentence whatever follows, and full stops that may also abbreviate.
STRONG = "。｡!！?？؟।॥۔።"
STOP = ".．"
ELLIPSIS = "…‥"
_MARKS = set(STRONG + STOP + ELLIPSIS)
_OPEN = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "〈": "〉", "《": "》", "［": "］", "‹": "›", "〔": "〕"}
_CLOSE = set(_OPEN.values()) | {"’"}
_ROUND = {"（": "(", "）": ")", "［": "[", "］": "]"}
_BRACKETS = set("（([【［〔")
_LIGHT = set(",，、،;；؛:：）)]】」』”»’")
# Particles that carry a sentence on after a quotation, and verbs of saying.
_QUOTATIVE = re.compile(r"(?:と|って|という|とか|라고|이라고|하고|고 |라는|など|だ|です|の|を|が|は|に|も)")
_SAYING_HAN = re.compile(r"\s*[^，,。！？!?\s]{0,8}?[说問问道答喊叫想笑讲講嘆叹写寫]")
_SAYING = re.compile(r"(?:\W*+\w++){0,3}?\W*+(?:says?|said|asks?|asked|wrote|writes|replied|answered|added|shouted|told|thought)\b", re.I)
# Abbreviations known without a corpus, those that never end a sentence and those that may.
_NEVER = "mr mrs ms dr prof st fig no vs approx ca bzw nr str sra sr srta dra pág p pp vol m mme mlle стр гг ул рис"
_MAY = "jr inc ltd co etc usw г"
_KNOWN = {token_key(w): v for words, v in ((_NEVER, "A"), (_MAY, "E")) for w in words.split()}

_W = rf"\w{chr(0x300)}-{chr(0x36F)}{INVISIBLE}"
_JOIN = ".．’'-‐–"
#: A token read backwards from its end.
_NEKOT = re.compile(rf"[{_W}]+(?:[.．’'\-‐–]+[{_W}]+)*")
_NEXT = re.compile(rf"[\s\"“„«»「『(（\[¿¡‹'‘—–-]*([{_W}]+)")
_MID = re.compile(r"[a-zа-яà-ÿ] $")
_EVENT = re.compile(rf"[{STRONG}{STOP}{ELLIPSIS}]+|[\"“”„«»「」『』（）()\[\]【】〈〉《》［］‹›〔〕＂]|\n\s*\n|(?<=[ก-ฺเ-๎])[{INVISIBLE}]*\s+[{INVISIBLE}]*(?=[ก-ฺเ-๎])")


def _before(text: str, at: int, start: int = 0) -> str:
    """The token right before position `at`, not reaching before `start`; '' if there is none."""
    size = 40
    while True:
        low = max(start, at - size)
        parts = text[low:at].rsplit(None, 1)
        if not parts:
            return ""
        chunk = parts[-1]
        cut = low > start and len(chunk) == at - low
        if chunk.isascii():
            chunk = chunk.lstrip("\"'([{<-/*_~")
            if chunk.isalnum() and not cut:
                return chunk
        m = _NEKOT.match(chunk[::-1])
        # A token that the stretch cuts off, or may, is looked for in a longer one.
        if cut and not (m and chunk[: len(chunk) - len(m[0])].strip(_JOIN)):
            size *= 4
            continue
        return m[0][::-1] if m else ""


def _shape(ch: str) -> str:
    """Class of what follows a full stop and a blank."""
    if ch.islower():
        return "l"
    if ch.isupper() or ch.istitle():
        return "u"
    return "d" if ch.isdecimal() else "o"


def _is_initials(token: str) -> bool:
    """A letter or several single letters with stops between them."""
    parts = re.split(r"[.．]", re.sub(rf"[{INVISIBLE}]", "", token))
    return all(len(p) <= 1 or (len(p) <= 2 and not p.isalpha()) for p in parts) and token[-1:].isalpha()


# ---------------------------------------------------------------- evidence

_SEEN = re.compile(rf"(?<=[{_W}])[.．](?![.．…])(?=(\s*)(\S?))")
_SHORT = re.compile(rf"(?<![{_W}.．])[a-zA-ZÀ-ɏЀ-ӿ]{{1,4}}(?![{_W}.．])")
_START = re.compile(rf"(?:[{STRONG}]\s|\n)\s*([{_W}]+)")


def evidence(text: str, into: Counter) -> None:
    """Adds what a text shows beyond doubt: (token, class) for tokens before a full stop, ('>' word) for sentence starts.

    Classes: l, u, d, o for what follows behind a blank, c for a comma or the like at once, e for the end of a line or
    of the text, p for short words without a stop. A number before a stop counts as '#', with the following capitalised word under 'm'.
    """
    for m in _START.finditer(text):
        if m[1][0].isupper():
            into[token_key(m[1]), "S"] += 1
        elif m[1][0].islower():
            into[token_key(m[1]), "s"] += 1
    if "." not in text and "．" not in text:
        return
    for w in _SHORT.findall(text):
        into[token_key(w), "p"] += 1
    for m in _SEEN.finditer(text):
        blank, after = m[1], m[2]
        number = text[m.start() - 1].isdecimal()
        if not blank and after:
            if after in ",，،;；؛":
                kind = "c"
            else:
                continue
        elif not after or "\n" in blank:
            kind = "e"
        elif after in "\"“„«「(（¿¡":
            kind = "q"
        else:
            kind = _shape(after)
        if number:
            if kind == "u" and (w := _NEXT.match(text, m.end(1))):
                into[token_key(w[1]), "m"] += 1
            continue
        if token := _before(text, m.start()):
            into[token_key(token), kind] += 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(seen)
        got = pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.string()), pa.array([c for _, c in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())],
            names=["word", "kind", "n"],
        )
        seen.clear()
        return got

    for b in batches:
        for t in b.column(0).to_pylist():
            evidence(t, seen)
        if len(seen) > 200_000:
            yield out()
    yield out()


def verdicts(texts: DataFrame) -> DataFrame:
    """What the corpus decides: (word, verdict), only for words whose evidence departs from an ordinary word.

    A: abbreviation that is not seen to end a sentence; E: one that may; T: title, before names only; W: ordinary word although short; s: word that starts
    sentences in lower case; N: capitalised word that follows numbers with a stop and starts no sentence (months).
    Counts are summed in Python per partition, then by word: one shuffle of distinct words.
    """
    counts = texts.mapInArrow(_count, "word string, kind string, n bigint").groupBy("word").agg(
        *(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"k_{k}" if k not in "Ss" else ("k_cap" if k == "S" else "k_low")) for k in "luodcqempSs")
    )
    before = F.col("k_l") + F.col("k_c") + F.col("k_d")
    total = before + F.col("k_u") + F.col("k_o") + F.col("k_q") + F.col("k_e")
    short = (F.length("word") <= 8) & ~F.col("word").rlike(r"\d")
    goes_on = short & (total >= 2) & (before >= 0.5 * total) & (F.col("k_e") <= 0.34 * total)
    abbreviates = goes_on | short & (
        ((total >= 20) & (F.length("word") <= 4) & (F.col("k_e") + F.col("k_o") + F.col("k_q") == 0) & (F.col("k_p") <= 0.05 * total))
    )
    ends = F.col("k_e") >= 0.02 * total
    verdict = (
        F.when(abbreviates & ends, "E")
        .when(goes_on, "A")
        .when(abbreviates, "T")
        .when(short & (F.length("word") <= 4) & (total >= 5) & ends & (before < 0.5 * total), "W")
    )
    starts = F.when(F.col("k_low") >= 3, "s").when(
        (F.col("k_m") >= 1) & (F.col("k_cap") <= 0.1 * F.col("k_m")), "N"
    )
    return counts.select("word", F.concat(F.coalesce(verdict, F.lit("")), F.coalesce(starts, F.lit(""))).alias("verdict")).where("verdict <> ''")


# ---------------------------------------------------------------- one text


def _pairs(text: str, events: list) -> dict[int, int]:
    """Opening position -> closing position of the quotations and brackets that are closed within the text.

    A mark closes the last one open that it fits, and whatever was opened since is given up. What is open is counted by
    the mark that closes it, so a mark that closes nothing costs nothing and the text is read once.
    """
    stack: list[tuple[str, str, int]] = []
    waiting: Counter = Counter()
    found: dict[int, int] = {}

    def shut(closer: str, opener: str | None, at: int) -> None:
        while stack:
            o, c, i = stack.pop()
            waiting[c] -= 1
            waiting[o] -= 1
            if c == closer and (opener is None or o == opener):
                found[i] = at
                return

    def put(opener: str, closer: str, at: int) -> None:
        stack.append((opener, closer, at))
        waiting[closer] += 1
        waiting[opener] += 1

    for m in events:
        c = m[0]
        if len(c) != 1 or c.isspace() or c in STRONG or c in STOP or c in ELLIPSIS:
            continue
        at = m.start()
        if c in '"＂':
            if waiting['"']:
                shut('"', None, at)
            else:
                put('"', '"', at)
            continue
        c = _ROUND.get(c, c)
        if c == "“" and waiting["„"]:
            shut("“", "„", at)
        elif c in _OPEN:
            closer = _OPEN[c]
            put(c, _ROUND.get(closer, closer), at)
        elif c in _CLOSE and waiting[c]:
            shut(c, None, at)
    return found


def boundaries(text: str, known: dict[str, str] | None = None) -> list[int]:
    """End of each sentence in characters, ascending. Blank texts have none."""
    known = known or {}
    n = len(text)
    last = n
    while last and (text[last - 1].isspace()):
        last -= 1
    if not last:
        return []
    events = list(_EVENT.finditer(text, 0, last))
    if not events:
        return [last]
    closed = _pairs(text, events) if any(m[0] in '"＂' or m[0] in _OPEN for m in events if len(m[0]) == 1) else {}
    ends: list[int] = []
    memo: dict[str, tuple[bool, bool]] = {}
    start = 0
    skip = -1

    def end(at: int) -> None:
        nonlocal start
        if said := text[start:at].rstrip():
            if said.strip():
                ends.append(start + len(said))
        start = at

    for m in events:
        at, stop = m.span()
        if at < skip:
            continue
        c = m[0]
        first = c[0]
        if at in closed:
            shut = closed[at]
            skip = shut + 1
            inner = text[at + 1 : shut].rstrip()
            if inner and (inner[-1] in STRONG or inner[-1] in STOP or inner[-1] in ELLIPSIS or inner[-1] in _CLOSE and inner[-2:-1] in STRONG + STOP):
                if _after_closing(text, start, at, shut, last, known):
                    to = shut + 1
                    while to < last and text[to] in _CLOSE and to not in closed:
                        to += 1
                    end(to)
                    skip = to
            continue
        if c[-1].isspace() or first not in _MARKS and len(c) > 1:
            end(at)
            continue
        if first not in _MARKS:
            continue
        marks = set(c)
        to = stop
        while to < last and (text[to] in _CLOSE or text[to] in '"＂' and _odd_quote(text, start, to)) and to not in closed:
            to += 1
        if to >= last:
            break
        if marks & set(STRONG):
            nxt = text[to]
            if nxt in _LIGHT and nxt not in _CLOSE:
                continue
            if c in "!?" and to == stop and nxt.isascii() and nxt.isalnum() and not (nxt.isupper() and text[at - 1 : at].isalpha()):
                continue
            end(to)
        elif marks & set(ELLIPSIS) or len(c) > 1:
            continue
        elif _stop_ends(text, at, to, start, known, memo):
            end(to)
    if text[start:last].strip():
        ends.append(last)
    return ends


def _odd_quote(text: str, start: int, at: int) -> bool:
    return text[start:at].count('"') % 2 == 1


def _after_closing(text: str, start: int, opened: int, shut: int, last: int, known: dict[str, str]) -> bool:
    """Whether a quotation or bracket whose last mark ends a sentence also ends the one around it."""
    to = shut + 1
    if to >= last:
        return False
    behind = to
    while behind < last and text[behind].isspace():
        behind += 1
    nxt = text[behind : min(behind + 1, last)]
    blank = behind > to
    if not nxt or nxt in _LIGHT or nxt in STRONG or nxt in STOP:
        return False
    alone = not text[start:opened].strip()
    if text[opened] in _BRACKETS:
        return alone
    if "\n" in text[to:behind]:
        return True
    if not blank and _QUOTATIVE.match(text, to):
        return False
    word = _NEXT.match(text, to)
    lower = nxt.islower() and not ("s" in known.get(token_key(word[1]), "") if word else False)
    if lower:
        return False
    if alone:
        return not (_SAYING if nxt.isascii() else _SAYING_HAN).match(text, behind)
    before = text[start:opened].rstrip()[-1:]
    return before in ":：,，、" or blank


def _stop_ends(text: str, at: int, to: int, start: int, known: dict[str, str], memo: dict[str, tuple[bool, bool]]) -> bool:
    """Whether the full stop at `at` ends a sentence; `to` is behind its closing marks, inside the text."""
    nxt = text[to]
    if not nxt.isspace():
        prior = text[at - 1 : at]
        if to > at + 1:
            return nxt not in _LIGHT
        if prior.islower() and (nxt.isupper() or nxt in "\"“„«「(（¿¡"):
            return _runs_on(text, at, to, start, known, memo)
        wide = "⺀" <= prior <= "鿿"
        return wide and not nxt.isascii() and nxt not in _LIGHT or nxt in "“「«" and prior.isalpha()
    if to > at + 1:
        word = _NEXT.match(text, to)
        return not (word and word[1][0].islower() and "s" not in known.get(token_key(word[1]), ""))
    token = _before(text, at, start)
    if not token:
        return True
    key = token_key(token)
    word = _NEXT.match(text, to)
    follows = word[1] if word else ""
    shape = _shape(follows[0]) if follows else "o"
    newline = "\n" in text[to : to + 1]
    if shape == "l":
        return "s" in known.get(token_key(follows), "") and not _abbreviates(text, token, key, known, memo)
    if token[-1].isdecimal():
        plain = token.isdecimal() and len(token) <= 2
        return not (shape == "u" and plain and not newline and "N" in known.get(token_key(follows), ""))
    judged = _abbreviates(text, token, key, known, memo)
    if not judged:
        return True
    if judged == "A" and shape == "u" and len(key) > 1 and key not in _KNOWN and _common(text, follows):
        return True
    if judged == "D" and shape == "u":
        return not _name(text, follows)
    if judged in ("E", "D"):
        return shape != "d"
    return False


def _name(text: str, word: str) -> bool:
    """Whether the document shows that a capitalised word is a name: it stands in it capitalised behind a small word or
    a comma, and nowhere in small letters."""
    small = word.lower()
    if small != word and re.search(rf"(?<![{_W}]){re.escape(small)}(?![{_W}])", text):
        return False
    return re.search(rf"[a-zа-яà-ÿ,] {re.escape(word)}(?![{_W}])", text) is not None


def _common(text: str, word: str) -> bool:
    """Whether the document shows that a capitalised word is no name: it stands in it in small letters, and nowhere
    capitalised behind a small word."""
    small = word.lower()
    if small == word or not re.search(rf"(?<![{_W}]){re.escape(small)}(?![{_W}])", text):
        return False
    return not re.search(rf"[a-zа-яà-ÿ,] {re.escape(word)}(?![{_W}])", text)


def _runs_on(text: str, at: int, to: int, start: int, known: dict[str, str], memo: dict[str, tuple[bool, bool]]) -> bool:
    """Whether a stop between a small letter and a capital, without a blank, ends a sentence whose blank was lost.

    Not behind abbreviations or single letters, nor before an extension or a name in capitals.
    """
    low = max(start, text.rfind(".", start, at) + 1)
    token = _before(text, at, low)
    # A token that holds a stop is none that ends a sentence.
    if len(token) < 2 or not token[-2:].isalpha() or low > start and len(token) == at - low:
        return False
    word = _NEXT.match(text, to)
    if word and len(word[1]) > 1 and word[1].isupper():
        return False
    return not _abbreviates(text, token, token_key(token), known, memo)


def _elsewhere(text: str, token: str, known: dict[str, str]) -> tuple[bool, bool]:
    """Whether the text has the token with a stop before a small letter or a comma, and whether it has it without one.

    A word known to start sentences in small letters tells nothing, nor does a capitalised one or a single letter
    without a stop, unless a small letter stands before it: at a start it may be another word (No, A).
    """
    small = bare = False
    at, size, n = text.find(token), len(token), len(text)
    while at >= 0:
        to = at + size
        if not (at and (text[at - 1].isalnum() or text[at - 1] in STOP)):
            if (size == 1 or token[0].isupper()) and not _MID.search(text, max(0, at - 3), at):
                pass
            elif to == n or not (text[to].isalnum() or text[to] in STOP):
                bare = True
            elif text[to] in STOP and to + 1 < n:
                if text[to + 1] == ",":
                    small = True
                elif text[to + 1].isspace():
                    word = _NEXT.match(text, to + 1)
                    small = word is not None and word[1][0].islower() and "s" not in known.get(token_key(word[1]), "")
            if small:
                return True, bare
        at = text.find(token, to)
    return small, bare


def _shown(text: str, token: str, known: dict[str, str], memo: dict[str, tuple[bool, bool]]) -> tuple[bool, bool]:
    """_elsewhere(), looked up once per text."""
    if token not in memo:
        memo[token] = _elsewhere(text, token, known)
    return memo[token]


def _abbreviates(text: str, token: str, key: str, known: dict[str, str], memo: dict[str, tuple[bool, bool]]) -> str:
    """'' for an ordinary word, 'A' or 'T' for an abbreviation, 'E' for one that may end a sentence, 'D' for one that
    only the document shows.

    The document decides first, for tokens of every length: one with a stop before a small letter or a comma is an
    abbreviation in all of it, else one without a stop an ordinary word. Then the corpus, then what is known without
    one; for an abbreviation of the document these only tell the kind.
    """
    before_small, bare = _shown(text, token, known, memo)
    if bare and not before_small:
        return ""
    verdict = known.get(key, "")
    corpus = next((v for v in verdict if v in "AETW"), "")
    if corpus in ("A", "E", "T"):
        return corpus
    if _is_initials(token):
        inner = "." in token or "．" in token
        return "E" if inner and (corpus == "W" or token.islower()) else "A"
    if before_small:
        return _KNOWN.get(key, "D")
    return "" if corpus == "W" else _KNOWN.get(key, "")


def _split_udf(known: dict[str, str]):
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else boundaries(t, known) for t in texts])

    return F.pandas_udf(split, "array<int>")


def _split_with(texts: pd.Series, words: pd.Series, marks: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else boundaries(t, {} if w is None else dict(zip(w, v))) for t, w, v in zip(texts, words, marks)])


def asked(text: str) -> set[str]:
    """Words of a text about which boundaries() may ask the corpus: the one before each full stop, and the one behind
    each mark, quotation or bracket, also where several close one after the other."""
    got = set()
    for m in _EVENT.finditer(text):
        at, to = m.span()
        if text[at] in STOP and (token := _before(text, at)):
            # A sentence may begin within what looks like one token.
            got.update(token_key(token[k:]) for k in range(len(token)) if not k or token[k - 1] in _JOIN)
        while True:
            if w := _NEXT.match(text, to):
                got.add(token_key(w[1]))
            if to < len(text) and (text[to] in _CLOSE or text[to] in '"＂'):
                to += 1
            else:
                break
    return got


def _asked(texts: pd.Series) -> pd.Series:
    return pd.Series([sorted(asked(t)) if t else [] for t in texts])


# ---------------------------------------------------------------- operator


def sentence_ends(df: DataFrame, text_col: str, corpus: DataFrame | None = None, keys: list[str] | None = None, most_broadcast: int = 200_000) -> DataFrame:
    """df with `ends`, an array: the number of characters up to and with the last one of each sentence.

    Null texts get null, empty and blank ones an empty array. Rows are taken as they come, repeated ones each for
    itself; an empty table stays empty. All columns pass through, one named `ends` is replaced. `corpus` is a DataFrame
    of one text column over which the statistics are made (default: df itself); every text is read to its end.

    The corpus's verdicts are few (see verdicts()); up to `most_broadcast` of them, counted first, go to the workers
    with the function. Beyond, each text's own words are joined with the table, for which `keys` must name columns
    that identify a row.
    """
    texts = (df.select(F.col(text_col).alias("t")) if corpus is None else corpus.toDF("t")).where("t is not null")
    table = verdicts(texts)
    head = table.limit(most_broadcast + 1).collect()
    if len(head) <= most_broadcast:
        return df.withColumn("ends", _split_udf({r["word"]: r["verdict"] for r in head})(text_col))
    if not keys:
        raise ValueError("keys are needed to join more verdicts than may be broadcast")
    word, words, marks = (free_name(df, c) for c in ("word", "words", "marks"))
    need = df.where(F.col(text_col).isNotNull()).select(*keys, F.explode(F.pandas_udf(_asked, "array<string>")(text_col)).alias(word)).dropDuplicates()
    told = need.join(table.withColumnRenamed("word", word).withColumnRenamed("verdict", marks), word)
    mine = told.groupBy(*keys).agg(F.collect_list(word).alias(words), F.collect_list(marks).alias(marks))
    joined = df.join(mine, keys, "left").withColumn("ends", F.pandas_udf(_split_with, "array<int>")(text_col, words, marks))
    return joined.drop(words, marks)

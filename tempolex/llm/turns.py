"""Speaker turns from diarized transcripts: boosted label decisions, filler classification, speaker normalisation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import stage
from .boosting import Boosted
from .glyphs import INVISIBLE, TO_LATIN, token_key

# How recognisers write speaker numbers, clock times and sounds.
_NUMBERED = re.compile(r"^(?:speaker|spk|s|说话人)0*(\d{1,3})$")
_CLOCK = r"\d{1,3}:\d\d(?::\d\d)?(?:[.,]\d{1,3})?"
_BOXED = rf"(?:[\[(【<]\s*{_CLOCK}\s*[\])】>])"
_STAMP = re.compile(rf"{_BOXED}|(?m:^)[ \t]*(?:\d{{1,3}}:)?\d\d:\d\d[.,]\d{{1,3}}(?:\s*-->(?:\s*{_CLOCK})?)?|(?m:^)[ \t]*\d{{1,3}}:\d\d:\d\d(?=\s|$)|{_CLOCK}\s*-->(?:\s*{_CLOCK})?")
_SOUND = re.compile(
    r"\(\([^()]*\)\)|\[[^\[\]\n]{1,40}\]|【[^【】\n]{1,40}】|<[^<>\n]{1,40}>|\{[^{}\n]{1,40}\}|\([^()\n.!?。！？]{1,24}\)|\*[^*\n]{1,24}\*|[♪♫♬]+[~～]*(?:[^♪♫♬\n]{0,40}[♪♫♬]+[~～]*)?|^\s*(?:>>)+\s*"
)
_WIDTH = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F) if c != 0xFF5E} | {0x3000: 0x20, 0xA0: 0x20, 0x2005: 0x20, 0x2009: 0x20, 0x202F: 0x20, 0x2002: 0x20, 0x2003: 0x20, 0x2007: 0x20}
_ENDS = ".!?。！？…\"”’」』)】]"


def _flat(text: str) -> str:
    """The text with widths and blanks unified and look-alike letters in Latin, character for character."""
    return text if text.isascii() else text.translate(_WIDTH).translate(_TWINS)


_TWINS = {ord(c): t for c, t in TO_LATIN.items()}


def name_key(name: str) -> str:
    return re.sub(r"[\s\-_.·]", "", token_key(name))


def _near(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or exchange of neighbours turns a into b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    ra, rb = a[i:], b[i:]
    return ra[1:] == rb or ra == rb[1:] or ra[1:] == rb[1:] or (len(ra) > 1 and len(rb) > 1 and ra[0] == rb[1] and ra[1] == rb[0] and ra[2:] == rb[2:])


@dataclass
class Roster:
    """Who may speak: normalised names to codes, and the pattern under which names are found."""

    names: dict[str, str]
    numbers: dict[int, str]
    han: list[str]
    memo: dict[str, tuple[str, int] | None] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[dict]) -> Roster:
        names: dict[str, str] = {}
        numbers, han = {}, []
        for r in rows:
            for n in (r["speaker_code"], r["name_zh"], r["name_en"], r["other_name"]):
                if n and (k := name_key(n)):
                    names.setdefault(k, r["speaker_code"])
                    if not k.isascii():
                        han.append(n)
            if r["diar_no"] is not None:
                numbers[int(r["diar_no"])] = r["speaker_code"]
        return cls(names, numbers, sorted(han, key=len, reverse=True))

    def code(self, name: str) -> tuple[str, int] | None:
        """Code of a written name and how it was met: 0 as listed, 1 by number, 2 with one slip; None if unknown."""
        if name in self.memo:
            return self.memo[name]
        k = name_key(name)
        if k in self.names:
            got = (self.names[k], 0)
        elif (m := _NUMBERED.match(k)) and int(m[1]) in self.numbers:
            got = (self.numbers[int(m[1])], 1)
        else:
            near = {c for n, c in self.names.items() if len(n) >= 4 and len(k) >= 4 and k[0] == n[0] and _near(k, n)}
            got = (near.pop(), 2) if len(near) == 1 else None
        if len(self.memo) < 50_000:
            self.memo[name] = got
        return got

    def pattern(self) -> re.Pattern:
        gap = rf"[\s{INVISIBLE}]*"
        han = "|".join(gap.join(map(re.escape, n)) for n in self.han)
        latin = rf"[a-z](?:[a-z0-9.'{INVISIBLE}]*)(?:[ _\-]{{1,2}}[a-z0-9.{INVISIBLE}]+)?"
        name = "|".join(x for x in (han, r"说话人\s?\d{1,3}", r"(?:speaker|spk|s)[ _\-]?\d{1,3}(?!\d)", latin) if x)
        close = rf"\s*[\])】>](?:\s*{_BOXED})?\s*:?"
        return re.compile(
            rf"(?P<mark>>>\s*)?(?P<open>[\[(【<]\s*(?:v\s+)?)?(?P<name>{name})(?P<sep>{close}|\s*{_BOXED}\s*:?|\s*:|[ \t]+(?:--?|—|–)(?=\s))", re.I
        )


@dataclass
class Candidate:
    start: int
    end: int
    code: str
    features: list[float]


#: What the boundary model sees of a candidate.
FEATURES = ("line_start", "after_end", "after_blank", "separator", "boxed", "met", "marked", "after_letter", "follows", "gap", "capital", "same_before", "nth", "stamped", "small_word_before")


def candidates(text: str, roster: Roster, pattern: re.Pattern, gap: float, before: str | None) -> tuple[str, list[Candidate]]:
    """Places of the flattened text that may name who speaks next, with their features."""
    flat = _flat(text)
    found: list[Candidate] = []
    stamps = [m.span() for m in _STAMP.finditer(flat)]
    last = before
    at = 0
    while m := pattern.search(flat, at):
        at = max(m.end("name"), m.start() + 1)
        name, start = m["name"], m.start("name")
        got = roster.code(name)
        if got is None:
            # The last word of two may be the name.
            cut = max(name.rfind(" "), name.rfind("_"), name.rfind("-"))
            got = roster.code(name[cut + 1 :]) if cut >= 0 else None
            if got is None:
                continue
            start += cut + 1
        boxed = bool(m["open"]) and start == m.start("name")
        sep = m["sep"].strip()
        closes = sep[:1] in "])】>" and not re.match(_BOXED, sep)
        if closes and not boxed:
            continue
        if boxed and not closes:
            boxed = False
        begin = m.start() if boxed or m["mark"] and start == m.start("name") else start
        # What is right before: 240 characters tell, however long the text is.
        low = max(0, begin - 240)
        cut = begin
        for a, b in stamps:
            if low <= b <= begin and not flat[b:begin].strip(" \t>"):
                cut = max(a, low)
        bare = re.sub(r"(?:>>|[♪♫♬~～])\s*$", "", _trail_sound(flat[low:cut])).rstrip(" \t")
        line_start = bare[-1:] == "\n" or not bare.strip() and low == 0
        prior = bare.rstrip()[-1:]
        tail = re.search(r"([A-Za-z]+)\s*$", flat[max(0, begin - 16) : begin])
        kind = 0 if sep.endswith(":") else 1 if sep in ("-", "--", "—", "–") else 2 if closes else 3
        rest = flat[m.end() :].split("\n", 1)[0].strip()
        x = [
            float(line_start),
            float(bool(prior) and prior in _ENDS),
            float(begin == 0 or flat[begin - 1].isspace()),
            float(kind),
            float(boxed),
            float(got[1]),
            float(bool(m["mark"])),
            float(begin > 0 and flat[begin - 1].isalpha()),
            float(min(len(rest), 60)),
            gap,
            float(flat[start].isupper()),
            float(got[0] == last),
            float(len(found)),
            float(bool(stamps)),
            float(bool(tail) and tail[1].islower()),
        ]
        end = m.end()
        found.append(Candidate(begin, end, got[0], x))
        last = got[0]
        at = end
    return flat, found


def _trail_sound(head: str) -> str:
    """The head without sounds and clock times at its end."""
    while True:
        cut = re.sub(r"(?:\[[^\[\]\n]*\]|\([^()\n]*\)|【[^【】\n]*】|<[^<>\n]*>|\{[^{}\n]*\}|\*[^*\n]*\*|[♪♫♬]+[~～]*)[ \t]*$", "", head)
        if cut == head:
            return head
        head = cut


# ---------------------------------------------------------------- fillers


def filler_pattern(words: list[str]) -> str:
    """Any of the words, each letter also drawn out."""
    out = []
    for w in sorted({token_key(w) for w in words if w and w.strip()}, key=lambda w: (-len(w), w)):
        parts = []
        for ch in w:
            if ch.isspace():
                parts.append(r"\s+")
            elif ch in "-‐–":
                parts.append(r"[\s\-‐–]*")
            else:
                parts.append(f"{re.escape(ch)}+[ー〜~～]*")
        out.append("".join(parts))
    return "(?:" + "|".join(out or ["(?!)"]) + ")"


@dataclass
class Fillers:
    """Which words fill pauses, where they stand, and whether a text holds anything else."""

    words: list[str]

    def __post_init__(self) -> None:
        p = filler_pattern(self.words)
        self.only = re.compile(rf"(?:[\W_]*{p})*[\W_]*", re.I)
        self.find = re.compile(rf"(?<![A-Za-z]){p}(?![A-Za-z])", re.I)
        self.order = {token_key(w): i for i, w in enumerate(sorted(set(self.words)))}

    def nothing_else(self, speech: str) -> bool:
        key = re.sub(rf"[{INVISIBLE}]", "", speech).lower()
        return self.only.fullmatch(key) is not None

    def features(self, speech: str, m: re.Match) -> list[float]:
        """Left and right neighbour, length, repetition, place, the word's number."""
        a, b = m.span()
        left, right = speech[:a].rstrip()[-1:], speech[b:].lstrip()[:1]
        klass = lambda c: 0.0 if not c else 1.0 if c in ",，、" else 2.0 if c in "…—-~～" else 3.0 if not c.isalnum() else 4.0
        word = re.sub(r"(.)\1+", r"\1", m[0].lower())
        return [klass(left), klass(right), float(len(m[0])), float(a == 0), float(bool(re.search(r"(.+)\1", m[0]))), float(self.order.get(m[0].lower(), self.order.get(word, -1)))]


# ---------------------------------------------------------------- models


@dataclass
class TurnModel:
    """Everything the workers need: roster, fillers, and the trained models.

    `label` judges candidates, `pause` how likely the speaker changes between two adjacent pieces by gap and context
    alone, `boundary` decides whether a turn begins between them, `filler` which words fill a pause.
    """

    roster: Roster
    fillers: Fillers
    label: Boosted
    pause: Boosted
    boundary: Boosted
    filler: Boosted


#: What the pause model sees of two adjacent pieces, and what the boundary model sees.
PAUSE_FEATURES = ("gap", "within_segment", "prior_ends", "prior_length", "next_length", "next_opens_with_filler", "prior_spoken")
PAIR_FEATURES = ("label", "same_speaker", "pause", "gap", "within_segment")


#: Candidates every transcript agrees on, (features that differ from zero), label; so that a corpus
#: without a counter-example of its own still knows one.
_PRIOR = [
    (dict(line_start=1, after_blank=1, follows=30, gap=0.1, capital=c, met=m, separator=s, boxed=b, stamped=t), 1)
    for c in (0, 1) for m in (0, 1, 2) for s, b in ((0, 0), (1, 0), (2, 1), (3, 0)) for t in (0, 1)
] + [
    (dict(after_end=1, after_blank=1, follows=30, gap=0.1, capital=c, met=m, marked=k), 1) for c in (0, 1) for m in (0, 1, 2) for k in (0, 1)
] + [
    (dict(after_letter=a, after_blank=1 - a, small_word_before=1 - a, follows=f, gap=0.1, met=m), 0) for a in (0, 1) for m in (0, 2) for f in (10, 30)
]


def _prior() -> tuple[np.ndarray, np.ndarray]:
    return np.array([[float(d.get(f, 0)) for f in FEATURES] for d, _ in _PRIOR]), np.array([y for _, y in _PRIOR], float)


def _pair_prior() -> tuple[np.ndarray, np.ndarray]:
    """Adjacent pieces every transcript agrees on: a label of another speaker begins a turn, nothing else does."""
    rows = [((p, s, 0.3, g, w), float(p > 0.5 and s < 1)) for p in (0.0, 0.1, 0.9, 1.0) for s in (0.0, 0.5, 1.0) for g in (-1.0, 0.1, 1.0) for w in (0.0, 1.0)]
    return np.array([x for x, _ in rows]), np.array([y for _, y in rows])


def _squeeze(text: str) -> str:
    return re.sub(rf"[\W_{INVISIBLE}]", "", _flat(text).lower())


def _weighted(px: np.ndarray, py: np.ndarray, x: list, y: list) -> Boosted:
    """Trees over what was seen; the prior weighs little beside it, and all where nothing was seen."""
    if not x:
        return Boosted().fit(px, py)
    weight = np.concatenate([np.full(len(py), 0.05), np.ones(len(y))])
    return Boosted().fit(np.vstack([px, np.array(x)]), np.concatenate([py, np.array(y)]), weight)


def train(rows: list, texts: dict, roster: Roster, fillers: Fillers) -> TurnModel:
    """The models from segments (result_id, content, gap), in order, and the cleaned texts of their runs.

    A candidate is a label if the run's text lacks it together with what follows: a label is cleaned away, a mention
    stays. Two adjacent pieces have a boundary between them if the second begins with a label of another speaker than
    the one before. A filler is one if the text joins its neighbours, in the segment or beyond it, without it.
    Undecidable cases are not used.
    """
    pattern = roster.pattern()
    x, y, fx, fy = [], [], [], []
    seen: list[tuple] = []
    for rid, content, gap in rows:
        clean = texts.get(rid)
        flat, found = candidates(content, roster, pattern, gap, None) if content else ("", [])
        truth: list[float | None] = []
        for c in found:
            after = _squeeze(flat[c.end : c.end + 40])[:5]
            label = _squeeze(flat[c.start : c.end])
            kept = bool(clean) and label + after in clean
            truth.append(None if not after or not clean or not kept and after not in clean else 0.0 if kept else 1.0)
            if truth[-1] is not None:
                x.append(c.features)
                y.append(truth[-1])
        seen.append((rid, flat, gap, found, truth))
    label = _weighted(*_prior(), x, y)

    # Pieces in order, each with what is known of the boundary before it.
    made = _pieces(seen, label)
    targets: list[float | None] = []
    speaker: str | None = None
    run = object()
    for piece in made:
        if piece.run != run:
            run, speaker = piece.run, None
        if piece.code is None:
            targets.append(0.0 if speaker else None)
        elif piece.truth is None:
            targets.append(None)
            speaker = piece.code if piece.label >= 0.5 else speaker
        elif not piece.truth:
            targets.append(0.0)
        else:
            targets.append(float(piece.code != speaker))
            speaker = piece.code
    px = _pause_features(made, fillers)
    told = [i for i, t in enumerate(targets) if t is not None]
    pause = Boosted(depth=4).fit(px[told], np.array([targets[i] for i in told])) if told else Boosted().fit(np.zeros((2, len(PAUSE_FEATURES))), np.array([0.0, 1.0]))
    bx = _pair_features(made, px, pause)
    boundary = _weighted(*_pair_prior(), [bx[i] for i in told], [targets[i] for i in told])

    for k, piece in enumerate(made):
        clean = texts.get(piece.run)
        if not clean:
            continue
        prior = _squeeze(made[k - 1].speech[-12:]) if k and made[k - 1].run == piece.run else ""
        behind = _squeeze(made[k + 1].speech[:12]) if k + 1 < len(made) and made[k + 1].run == piece.run else ""
        for m in fillers.find.finditer(piece.speech):
            left = (prior + _squeeze(piece.speech[max(0, m.start() - 12) : m.start()]))[-4:]
            right = (_squeeze(piece.speech[m.end() : m.end() + 12]) + behind)[:4]
            if len(right) < 3:
                continue
            with_it, without = left + _squeeze(m[0]) + right in clean, left + right in clean
            if with_it != without:
                fx.append(fillers.features(piece.speech, m))
                fy.append(float(without))
    filler = Boosted().fit(np.array(fx), np.array(fy)) if fx else Boosted().fit(np.array([[0.0] * 6, [4.0] * 6]), np.array([1.0, 0.0]))
    return TurnModel(roster, fillers, label, pause, boundary, filler)


@dataclass
class Piece:
    """A stretch of speech that may begin a turn: the head of a segment, or what is behind a candidate in it."""

    run: object
    segment: int
    code: str | None
    label: float
    truth: float | None
    gap: float
    inside: bool
    speech: str
    start: int
    end: int
    same: float = 0.5


def _pieces(seen: list[tuple], label: Boosted, before: str | None = None) -> list[Piece]:
    """Pieces of segments (run, flat text, gap, candidates, truths) in order; runs that change forget the speaker.

    A candidate that the label model refuses stays in the speech of the piece it stands in, but is looked at as a
    piece of its own by the boundary model too.
    """
    x = [c.features for *_, found, _ in seen for c in found]
    p = iter(label.probability(np.array(x)) if x else [])
    out: list[Piece] = []
    speaker, run = before, seen[0][0] if seen else None
    for k, (rid, flat, gap, found, truth) in enumerate(seen):
        if rid != run:
            run, speaker = rid, None
        heads: list[tuple] = [(0, 0, None, 0.0, None)] + [(c.start, c.end, c.code, float(next(p)), t) for c, t in zip(found, truth)]
        said = [_SOUND.sub(" ", _STAMP.sub(" ", flat[h[1] : heads[j + 1][0] if j + 1 < len(heads) else len(flat)])) for j, h in enumerate(heads)]
        # With nothing said before it, a candidate stands at the head of the segment.
        first = int(len(heads) > 1 and not any(ch.isalnum() for ch in said[0]))
        for j in range(first, len(heads)):
            _, start, code, prob, t = heads[j]
            end = heads[j + 1][0] if j + 1 < len(heads) else len(flat)
            same = 0.5 if speaker is None else float(code is None or code == speaker)
            out.append(Piece(rid, k, code, prob, t, gap if j == first else 0.0, j > first, said[j], start, end, same))
            if code is not None and prob >= 0.5:
                speaker = code
    return out


def _pause_features(pieces: list[Piece], fillers: Fillers) -> np.ndarray:
    out = np.zeros((len(pieces), len(PAUSE_FEATURES)))
    prior = None
    for k, p in enumerate(pieces):
        said = prior.speech.rstrip() if prior is not None and prior.run == p.run else ""
        head = p.speech.lstrip()
        out[k] = (p.gap, p.inside, said[-1:] in _ENDS if said else 0, min(len(said), 80), min(len(head), 80), bool(fillers.find.match(head)), bool(said))
        prior = p
    return out


def _pair_features(pieces: list[Piece], pauses: np.ndarray, pause: Boosted) -> np.ndarray:
    if not pieces:
        return np.zeros((0, len(PAIR_FEATURES)))
    odds = pause.probability(pauses)
    return np.array([(p.label, p.same, o, p.gap, float(p.inside)) for p, o in zip(pieces, odds)])


# ---------------------------------------------------------------- one segment after the other


def _speech(flat: str, original: str, a: int, b: int) -> tuple[str, str]:
    """Speech between two places without clock times and sounds: (flat, as written)."""
    part, raw = flat[a:b], original[a:b]
    spans = sorted(m.span() for p in (_STAMP, _SOUND) for m in p.finditer(part))
    keep_f, keep_r, at = [], [], 0
    for s, e in spans:
        if e <= at:
            continue
        s = max(s, at)
        keep_f.append(part[at:s])
        keep_r.append(raw[at:s])
        at = e
    return " ".join([*keep_f, part[at:]]), " ".join([*keep_r, raw[at:]])


def parts_of(batch: list[tuple[str | None, float]], model: TurnModel, with_text: bool = False, runs: list | None = None, before: str | None = None) -> list[list[tuple[str | None, bool, str]]]:
    """Of each segment (content, gap), in order: (speaker who begins a turn or None, whether anything is spoken, cleaned speech).

    `runs` tells which segments follow each other (default: none does), `before` who speaks before the first. For every
    two adjacent pieces the boundary model decides whether a turn begins between them; without a label nobody is known
    to begin one, and the speaker before goes on. Something is spoken if letters are left beside the words that the
    filler model takes for fillers, unless the whole is nothing but words of the list.
    """
    pattern = model.roster.pattern()
    seen = []
    for k, (content, gap) in enumerate(batch):
        flat, found = candidates(content, model.roster, pattern, gap, None) if content else ("", [])
        seen.append((k if runs is None else runs[k], flat, gap, found, [None] * len(found)))
    pieces = _pieces(seen, model.label, before)
    begins = model.boundary.probability(_pair_features(pieces, _pause_features(pieces, model.fillers), model.pause)) >= 0.5 if pieces else []
    # A refused candidate is speech of the piece it stands in.
    spans: list[list] = []
    for piece, begin in zip(pieces, begins):
        if piece.code is not None and piece.label < 0.5:
            if piece.inside:
                spans[-1][3] = piece.end
            else:
                spans.append([piece.segment, None, 0, piece.end, False])
        else:
            spans.append([piece.segment, piece.code if begin else None, piece.start, piece.end, piece.code is not None])
    said = [_speech(seen[k][1], batch[k][0], a, b) if batch[k][0] else ("", "") for k, _, a, b, _ in spans]
    fillers = [list(model.fillers.find.finditer(speech)) for speech, _ in said]
    x = [model.fillers.features(speech, m) for (speech, _), ms in zip(said, fillers) for m in ms]
    drops = iter(model.filler.probability(np.array(x)) >= 0.5 if x else [])
    out: list[list[tuple[str | None, bool, str]]] = [[] for _ in batch]
    for (k, code, _, _, labelled), (speech, raw), ms in zip(spans, said, fillers):
        gone = [m.span() for m in ms if next(drops)]
        spoken = any(ch.isalnum() for ch in _without(speech, gone)) and not model.fillers.nothing_else(speech)
        if labelled or spoken:
            out[k].append((code, spoken, _tidy(raw, gone) if spoken and with_text else ""))
    return out


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def _tidy(raw: str, gone: list[tuple[int, int]]) -> str:
    """Speech without the spans and what strands behind them, blanks and commas at its ends tidied."""
    for a, b in reversed(gone):
        while b < len(raw) and raw[b] in ",，、… \t~～":
            b += 1
        raw = raw[:a] + raw[b:]
    return re.sub(r"\s+", " ", raw).strip(" ,，、-—")


def clean_speech(speech: str, raw: str, model: TurnModel) -> str:
    """Speech as written, without the fillers the model recognises, blanks and stranded commas tidied."""
    found = list(model.fillers.find.finditer(speech))
    drop = model.filler.probability(np.array([model.fillers.features(speech, m) for m in found])) >= 0.5 if found else []
    return _tidy(raw, [m.span() for m, d in zip(found, drop) if d])


_LOCAL = "result_id bigint, block bigint, local_no int, speaker string, first_no int, first_id bigint, last_no int, last_id bigint, n_segments int, end_speaker string, text string"


def _local_turns(model: TurnModel, with_text: bool):
    """Function over partitions sorted by run, block and number: the turns within each block, the first of unknown speaker.

    A row with `mark` stands before its block and tells when the one before it ended, so every gap is known.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows, current, prev_to, last = None, [], None, None, None
        done: list[tuple] = []

        def flush() -> None:
            if key is not None and (rows or current is not None):
                if not rows:
                    done.append((*key, -1, None, None, None, None, None, 0, current, None))
                for k, r in enumerate(rows):
                    done.append((*key, k, *r[:5], r[5], current, " ".join(t for t in r[6] if t) if with_text else None))

        for pdf in frames:
            todo, meta = [], []
            for rid, block, no, sid, mark, a, b, content in zip(*(pdf[c].tolist() for c in ("result_id", "block", "seg_no", "segment_id", "mark", "from_s", "to_s", "content"))):
                if last == (rid, block, no, sid):
                    continue
                if last is None or last[:2] != (rid, block):
                    prev_to = None
                last = (rid, block, no, sid)
                if mark:
                    # A row that only tells when the block before ended.
                    prev_to = b
                    continue
                gap = a - prev_to if prev_to is not None and a is not None and a == a and prev_to == prev_to else -1.0
                todo.append((content, float(gap)))
                meta.append((rid, block, no, sid))
                prev_to = b
            for (rid, block, no, sid), parts in zip(meta, parts_of(todo, model, with_text, [m[:2] for m in meta], current if meta and key == meta[0][:2] else None)):
                if key != (rid, block):
                    flush()
                    key, rows, current = (rid, block), [], None
                for code, spoken, text in parts:
                    if code is not None:
                        current = code
                    if not spoken:
                        continue
                    if rows and rows[-1][0] == current:
                        r = rows[-1]
                        r[3], r[4] = no, sid
                        r[5] += 1
                        r[6].append(text)
                    else:
                        rows.append([current, no, sid, no, sid, 1, [text]])
            if done:
                yield _frame(done)
                done.clear()
        flush()
        if done:
            yield _frame(done)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in _LOCAL.split(", ")]
    df = pd.DataFrame(rows, columns=names)
    for c in ("speaker", "end_speaker", "text"):
        df[c] = df[c].astype(object)
    for c in ("first_no", "last_no"):
        df[c] = df[c].astype("Int32")
    for c in ("first_id", "last_id"):
        df[c] = df[c].astype("Int64")
    return df


def speaker_turns(
    segments: DataFrame, runs: DataFrame, speakers: DataFrame, fillers: DataFrame, with_text: bool = False, sample_runs: int = 300, sample_segments: int = 12_000, sample_chars: int = 200_000, block: int = 1024, most_broadcast: int = 200_000, most_names: int = 100_000
) -> DataFrame:
    """Turns of every diarized run: (result_id, turn_no, speaker_code, first_segment_id, last_segment_id, n_parts[, part_no, text]).

    Labels are found anywhere in the content and judged by gradient-boosted trees over their surroundings (FEATURES, of
    which at most the 240 characters before a label); names are normalised against `speakers` (all spellings,
    recogniser numbers, one slip of the pen). Whether a turn begins between two adjacent segments, or at a label within
    one, is decided by trees over the label's judgement, the speaker before and the odds of a change by gap and context
    (PAIR_FEATURES, PAUSE_FEATURES). What is left after labels, clock times and sounds is speech, unless the filler
    model leaves nothing of it, or it holds nothing but words of `fillers`. Speech without a
    label goes on with the speaker before; before the first label of a run it belongs to nobody and is left out. A part
    of a segment counts once in n_parts. Rows with null ids or numbers are left out; rows delivered again count once;
    an empty roster gives no turn, more than `most_names` speakers or fillers raise ValueError. Other columns are ignored. With `with_text` the cleaned speech is given, one row per
    turn and block (part_no), so a turn of any length is never gathered in one place; a turn's other columns repeat.

    The models are trained on at most `sample_segments` segments of `sample_runs` runs (the smallest by a hash of their
    ids) whose cleaned text is given and has at most `sample_chars` characters. All else covers every row: runs are cut
    into blocks of `block` segments, each sorted and read as a stream, so a run may hold any share of all rows; turns
    that cross blocks are joined over one summary row per block.
    """
    spark = segments.sparkSession
    roster = Roster.of([r.asDict() for r in _whole(speakers, most_names, "speakers")])
    model_fillers = Fillers([r["word"] for r in _whole(fillers.select("word"), most_names, "fillers") if r["word"]])
    own = segments.where("result_id is not null and seg_no is not null and segment_id is not null").select("result_id", "seg_no", "segment_id", "from_s", "to_s", "content")
    diarized = runs.where("diarized and result_id is not null").select("result_id").distinct()
    few = diarized.limit(most_broadcast + 1).count() <= most_broadcast
    own = own.join(F.broadcast(diarized) if few else diarized, "result_id", "left_semi")
    model = _trained(own, runs, roster, model_fillers, sample_runs, sample_segments, sample_chars)

    cells = own.withColumn("block", F.floor(F.col("seg_no") / F.lit(block)).cast("bigint")).withColumn("mark", F.lit(0))
    order = W.partitionBy("result_id").orderBy("block")
    # One row per block, put before the next one of its run: when it ended.
    last = cells.groupBy("result_id", "block").agg(F.max_by(F.struct("to_s"), F.struct("seg_no", "segment_id")).alias("l"))
    marks = last.withColumn("next", F.lead("block").over(order)).where("next is not null").select(
        "result_id", F.lit(-(1 << 31)).alias("seg_no"), F.lit(-1).cast("bigint").alias("segment_id"), F.lit(None).cast("double").alias("from_s"), F.col("l.to_s").alias("to_s"),
        F.lit(None).cast("string").alias("content"), F.col("next").alias("block"), F.lit(1).alias("mark"),
    )
    both = cells.unionByName(marks)
    local = stage(
        both.repartition("result_id", "block").sortWithinPartitions("result_id", "block", F.desc("mark"), "seg_no", "segment_id").mapInPandas(_local_turns(model, with_text), _LOCAL),
        "turns",
    )
    # One row per block: the speaker it ends with, carried over blocks that name none.
    ends = local.groupBy("result_id", "block").agg(F.max("end_speaker").alias("end_speaker"))
    carried = ends.withColumn("carry", F.last("end_speaker", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))).select("result_id", "block", "carry")
    named = local.where("local_no >= 0").join(carried, ["result_id", "block"]).withColumn("speaker", F.coalesce("speaker", "carry")).where("speaker is not null")
    # Within a block neighbours differ, save that the part before the first label may be by the one it names.
    inner = W.partitionBy("result_id", "block").orderBy("local_no")
    fresh = named.withColumn("fresh", (~F.col("speaker").eqNullSafe(F.lag("speaker").over(inner))).cast("int"))
    placed = fresh.withColumn("at", F.sum("fresh").over(inner.rowsBetween(W.unboundedPreceding, 0)))
    blocks = placed.groupBy("result_id", "block").agg(
        F.max("at").alias("n"), F.min_by("speaker", "local_no").alias("head"), F.max_by("speaker", "local_no").alias("tail")
    )
    joined = (
        blocks.withColumn("merged", F.col("head").eqNullSafe(F.lag("tail").over(order)).cast("int"))
        .withColumn("through", F.sum(F.col("n") - F.col("merged")).over(order.rowsBetween(W.unboundedPreceding, 0)))
        .select("result_id", "block", (F.col("through") - F.col("n")).alias("offset"))
    )
    numbered = placed.join(joined, ["result_id", "block"]).withColumn("turn_no", (F.col("offset") + F.col("at")).cast("int"))
    keys = ["result_id", "turn_no"]
    turns = numbered.groupBy(*keys).agg(
        F.first("speaker").alias("speaker_code"),
        F.min_by("first_id", F.struct("first_no", "block", "local_no")).alias("first_segment_id"),
        F.max_by("last_id", F.struct("last_no", "block", "local_no")).alias("last_segment_id"),
        F.sum("n_segments").alias("n_parts"),
    )
    if not with_text:
        return turns
    texts = numbered.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("local_no", "text"))).alias("t"))
    texts = texts.select(*keys, F.col("block").alias("part_no"), F.array_join(F.transform("t", lambda r: r["text"]), " ").alias("text"))
    return turns.join(texts, keys)


def _whole(table: DataFrame, most: int, name: str) -> list:
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {name}")
    return rows


def _trained(own: DataFrame, runs: DataFrame, roster: Roster, fillers: Fillers, sample_runs: int, sample_segments: int, sample_chars: int) -> TurnModel:
    told = runs.where("diarized and result_id is not null and text is not null").where((F.length("text") > 0) & (F.length("text") <= sample_chars))
    some = told.select("result_id", "text").orderBy(F.xxhash64("result_id"), "result_id").limit(sample_runs).collect()
    texts = {r["result_id"]: _squeeze(r["text"]) for r in some}
    rows = []
    if texts:
        picked = own.where(F.col("result_id").isin(list(texts)) & F.col("content").isNotNull())
        # Neighbours are needed for the gap, so runs are taken whole while they fit, in the order of the hash.
        seen = picked.orderBy(F.xxhash64("result_id"), "result_id", "seg_no", "segment_id").limit(sample_segments).collect()
        prior = None
        for r in seen:
            same = prior is not None and prior["result_id"] == r["result_id"]
            if same and prior["segment_id"] == r["segment_id"]:
                continue
            gap = r["from_s"] - prior["to_s"] if same and r["from_s"] is not None and prior["to_s"] is not None else -1.0
            rows.append((r["result_id"], r["content"], gap))
            prior = r
    return train(rows, texts, roster, fillers)

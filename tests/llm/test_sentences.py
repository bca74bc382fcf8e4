import random

import pytest
from pyspark.sql import functions as F

from tempolex.llm.sentences import boundaries, sentence_ends, verdicts


def cut(text, known=None):
    out, at = [], 0
    for e in boundaries(text, known):
        out.append(text[at:e].strip())
        at = e
    return out


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("你好。再见！真的吗？！好", ["你好。", "再见！", "真的吗？！", "好"]),
        ("这个……其实不难。对…", ["这个……其实不难。", "对…"]),
        ("他说：“先背。后面懂。”29年前。", ["他说：“先背。后面懂。”", "29年前。"]),
        ("“有用吗？”七月反问了一句。好。", ["“有用吗？”七月反问了一句。", "好。"]),
        ("弹幕里全是“懂了！”。好。", ["弹幕里全是“懂了！”。", "好。"]),
        ("（这段可以跳过。）下一句。", ["（这段可以跳过。）", "下一句。"]),
        ("(这段可以跳过。）下一句。", ["(这段可以跳过。）", "下一句。"]),
        ("先生は「覚えて。慣れです。」と言いました。次。", ["先生は「覚えて。慣れです。」と言いました。", "次。"]),
        ("Dr. Hennrach sagte: „Zuerst. Dann.“ Der Rest.", ["Dr. Hennrach sagte: „Zuerst. Dann.“", "Der Rest."]),
        ('"Is it useful?" asked Jonas, and left. Yes.', ['"Is it useful?" asked Jonas, and left.', "Yes."]),
        ("It is 3.14 now. Open notes.md and v1.2.3. Done", ["It is 3.14 now.", "Open notes.md and v1.2.3.", "Done"]),
        ("See Fig. 3 by Mr. Oakley, e.g. here. Next", ["See Fig. 3 by Mr. Oakley, e.g. here.", "Next"]),
        ("We record at 3 p.m. Well... maybe not. Or at 4 p.m. and later.", ["We record at 3 p.m.", "Well... maybe not.", "Or at 4 p.m. and later."]),
        ("J. K. Marlow came. She left.", ["J. K. Marlow came.", "She left."]),
        ("ทำไมถึง VidKit 3 ครั้ง แล้วไป ครั้งหน้า", ["ทำไมถึง VidKit 3 ครั้ง", "แล้วไป", "ครั้งหน้า"]),
        ("शिक्षक ने कहा, “देखो। बाद में।” ठीक।", ["शिक्षक ने कहा, “देखो। बाद में।”", "ठीक।"]),
        ("لماذا؟ قال المعلم: «ابدأ. والباقي». نعم.", ["لماذا؟", "قال المعلم: «ابدأ. والباقي».", "نعم."]),
        ("선생님이 “먼저. 나중.”라고 했어요. 네.", ["선생님이 “먼저. 나중.”라고 했어요.", "네."]),
        ("M. Bruvelle a dit : « Euh. Oui. » Non.", ["M. Bruvelle a dit : « Euh. Oui. »", "Non."]),
        ("It works better.The live set.Is it?Yes! No!Well done. See a.Bc and x.MD", ["It works better.", "The live set.", "Is it?", "Yes!", "No!", "Well done.", "See a.Bc and x.MD"]),
        ('It is over."Is it?" asked Theo.(You can skip it.) See Dr.Tamsin', ["It is over.", '"Is it?" asked Theo.', "(You can skip it.)", "See Dr.Tamsin"]),
        ("no mark at all", ["no mark at all"]),
        ("one\n\ntwo", ["one", "two"]),
        ("  \n ", []),
        ("", []),
    ],
)
def test_cases(text, want):
    assert cut(text) == want


def test_ends_count_characters_and_leave_out_blanks():
    assert boundaries("Ｄｒ. A came.  \n B.  ") == [11, 17]
    assert boundaries("one  \n\n two ") == [3, 11]
    assert boundaries("边​界。好。") == [4, 6]


def test_corpus_verdicts_decide():
    text = "Es gilt am 3. Mai zehn. vidkit prints."
    assert cut(text) == ["Es gilt am 3.", "Mai zehn. vidkit prints."]
    assert cut(text, {"mai": "N", "vidkit": "s"}) == ["Es gilt am 3. Mai zehn.", "vidkit prints."]


def test_the_document_decides_before_the_corpus():
    assert cut("Take the ref. it helps. Read ref. Next.") == ["Take the ref. it helps.", "Read ref.", "Next."]
    assert cut("The st is here. Take st. Next.") == ["The st is here.", "Take st.", "Next."]


def test_the_document_overrides_contradicting_verdicts():
    # The corpus takes an ordinary word for an abbreviation, of whatever length.
    for word, verdict in (("min", "A"), ("min", "E"), ("vitamin", "A"), ("st", "T"), ("K", "A")):
        assert cut(f"The {word} is here. Take {word}. Next.", {word.lower(): verdict}) == [f"The {word} is here.", f"Take {word}.", "Next."]
    # The corpus takes an abbreviation of the document for an ordinary word; only a name goes on behind it.
    for word in ("ref", "approxim", "superintendent"):
        told = {word: "W"}
        assert cut(f"The {word}. it helps. We saw Oakley there. Ask {word}. Oakley now. Read {word}. Next.", told) == [f"The {word}. it helps.", "We saw Oakley there.", f"Ask {word}. Oakley now.", f"Read {word}.", "Next."]
        assert cut(f"The {word}. it helps. So says Well. All is well. Ask {word}. Well now.", told)[-2:] == [f"Ask {word}.", "Well now."]
    # Words and initials at a start of a sentence show nothing.
    assert cut("No, we wait. A plane came. See No. 25 by A. Marlow.", {"no": "A"}) == ["No, we wait.", "A plane came.", "See No. 25 by A. Marlow."]


def test_names_and_common_words_behind_an_abbreviation():
    known = {"u.s": "A", "dr": "T"}
    assert cut("He left the U.S. The plane was the last.", known) == ["He left the U.S.", "The plane was the last."]
    assert cut("He joined the U.S. Army there. The army is large, so the Army said.", known)[0] == "He joined the U.S. Army there."
    assert cut("Ask Dr. Will first. We will see.", known) == ["Ask Dr. Will first.", "We will see."]


def test_verdicts(spark):
    t = ["We wait 5 min. before it, min. after it. The min we had. Am 3. Mai ist es.\nAm 4. Mai auch! vidkit a. ok? vidkit b! vidkit c"] * 5 + ["Der Fall. Es geht.\nIm Fall. Ja."]
    got = {r["word"]: r["verdict"] for r in verdicts(spark.createDataFrame([(x,) for x in t], "t string")).collect()}
    assert got["min"] == "A" and got["mai"] == "N" and got["vidkit"] == "s" and "fall" not in got


def test_join_path_equals_broadcast(spark, data):
    r = spark.read.parquet(f"{data}/results.parquet").select("result_id", "text", F.lit(1).alias("word"), F.lit(2).alias("words"))
    a = {x["result_id"]: x["ends"] for x in sentence_ends(r, "text").collect()}
    b = {x["result_id"]: x["ends"] for x in sentence_ends(r, "text", keys=["result_id"], most_broadcast=1).collect()}
    assert a == b and sentence_ends(r, "text", keys=["result_id"], most_broadcast=1).columns == [*r.columns, "ends"]


def test_nulls_empty_repeats(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Yes. No."), (3, "Yes. No.")], "i int, text string")
    assert sorted((r["i"], r["ends"]) for r in sentence_ends(df, "text").collect() if r["i"] > 1) == [(2, []), (3, [4, 8]), (3, [4, 8])]
    assert sentence_ends(df.limit(0), "text").count() == 0
    with pytest.raises(ValueError):
        sentence_ends(df, "text", most_broadcast=-1)


def test_very_long_text():
    text = "Use ab. x or cd. Then (go on. " * 20_000
    assert boundaries(text)[-1] <= len(text)


class Recording(dict):
    """Verdicts that note which words are asked for."""

    def get(self, key, default=""):
        self.setdefault("\0", set()).add(key)
        return dict.get(self, key, default)


PIECES = ["Dr", "e.g", "iPhone", "etc", "Smith", "no", "5", "a", "U.S", "ul. Long", "“", "”", "(", ")", "’", "\"", "’ ", "»", "«", ".", ". ", ".) ", ".” ", "!", "! ", "。", "\n", " ", " ", ", ", "x" * 50, "said"]


@pytest.mark.parametrize("seed", range(40))
def test_all_words_asked_for_are_told_beforehand(seed):
    from tempolex.llm.sentences import asked

    rng = random.Random(seed)
    for _ in range(40):
        text = "".join(rng.choice(PIECES) for _ in range(30))
        known = Recording({"iphone": "s", "dr": "A", "etc": "E"})
        boundaries(text, known)
        assert dict.get(known, "\0", set()) <= asked(text), text


def test_both_ways_of_telling_verdicts_agree_on_quotations(spark):
    rows = [(i, t) for i, t in enumerate(['He said "Stop it!" iPhone sales rose again. ' * 2, "(Done!) iPhone sales rose. Dr. No came.", None, "", "“Go.” iPhone."])]
    df = spark.createDataFrame(rows, "id bigint, text string")
    corpus = spark.createDataFrame([("Yes! iPhone sales rose.",)] * 5 + [("The etc. of it, the etc. and so on",)] * 9, "t string")
    one = [r["ends"] for r in sentence_ends(df, "text", corpus, ["id"]).orderBy("id").collect()]
    other = [r["ends"] for r in sentence_ends(df, "text", corpus, ["id"], most_broadcast=0).orderBy("id").collect()]
    assert one == other and 18 in one[0]


def test_tokens_and_brackets_have_no_limit():
    from tempolex.llm.sentences import _before

    long = "Donaudampfschifffahrtsgesellschaftskapitaensmuetze" * 3
    assert _before(f"die {long}", len(long) + 4) == long
    assert _before(f"die x-{long}", len(long) + 6) == "x-" + long
    assert _before("." * 80 + "ab", 82) == "ab" and _before(" " * 80, 80) == ""
    deep = "(" * 100 + "x" + ")" * 100
    text = f"One {deep} two. Three."
    assert boundaries(text) == [text.index("two.") + 4, len(text)]
    assert boundaries("(" * 200_000) == [200_000] and boundaries(")" * 200_000) == [200_000]
    assert boundaries("„" * 100_000 + "“" * 100_000) == [200_000]


def test_a_contrary_verdict_of_the_corpus_does_not_overrule_the_document():
    text = "Put it by the bin. The bin was red. We saw the bin. Then it rained."
    for verdict in ("A", "T", "E"):
        assert len(boundaries(text, {"bin": verdict})) == 4
    text = "The apt. is small, this apt. was cheap, and our apt. Miller lives with Miller, as Miller does."
    for verdict in ("W", ""):
        assert boundaries(text, {"apt": verdict}) == [len(text)]

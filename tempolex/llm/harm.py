"""Abusive, hateful and sexual content: voters, a generative label model over them, a linear classifier on its labels."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .glyphs import TO_LATIN, compatible
from .mixing import source_key

# ---------------------------------------------------------------- fixed values: lexicons
# Words that insult, by language; the parts in brackets of a pattern are ordinary regular expressions.
_ZH_NOUNS = "傻逼 傻叉 煞笔 智障 脑残 弱智 废物 垃圾玩意 垃圾东西 人渣 贱人 贱货 畜生 狗东西 狗杂种 杂种 蠢货 白痴 丑八怪 王八蛋 混蛋 败类 婊子 窝囊废 猪脑子 蠢猪 狗屁东西 神经病 死肥猪 臭傻子".split()
_ZH_SEXUAL = "裸照 果照 裸聊 约炮 脱光 呻吟 做爱 自慰 无码 露点 口交 淫荡 骚货 一夜情".split()
#: How their characters are spelt when disguised.
_PINYIN = dict(
    p.split("=") for p in "傻=sha 逼=bi 智=zhi 障=zhang 脑=nao 残=can 废=fei 物=wu 垃=la 圾=ji 渣=zha 贱=jian 人=ren 畜=chu 生=sheng 狗=gou 蠢=chun 货=huo 白=bai 痴=chi 约=yue 炮=pao 裸=luo 聊=liao 照=zhao 果=guo 丑=chou 怪=guai".split()
)
_INITIALS = {"sb": "傻逼", "zz": "智障", "nc": "脑残", "fw": "废物", "nmsl": "你妈死了", "cnm": "操你妈", "rz": "人渣", "lj": "垃圾"}
_EN_NOUNS = "idiot moron dumbass asshole scumbag bitch bastard loser cunt cretin imbecile retard dickhead shithead halfwit scum prick whore slut pig rat clown donkey".split()
_EN_PHRASES = "piece of (?:trash|shit|garbage|filth);waste of (?:oxygen|space|air);brain[- ]?dead;worthless (?:clown|loser|idiot|human|person|pig|thing);pathetic (?:rat|excuse|loser|human|creature);braying donkey;stupid (?:pig|cow|bitch|idiot|ass|man|woman|kid)".split(";")
_EN_OTHER = "shut crawl vomit smash beaten knife ditch vermin parasites animals stink thieving breed human nudes naked horny tits strip moan sex dirty pics panties deeper deserve vote women disabled believers immigrants foreigners trust pathetic worthless stupid trash voice uploader people account link already night oxygen girls link roof school wet bed hate you your".split()
_GROUP_ZH = "外地人|乡下人|农村人|南方人|北方人|女人|男人|老年人|老人|残疾人|外国人|信教的|黑人|白人|犹太人|穆斯林|移民|难民|同性恋|穷人|少数民族|打工的|胖子"
_GROUP_EN = r"(?:foreigners?|immigrants?|refugees|migrants|women|girls|disabled (?:kids|people|children)|old people|country folk|poor people|people from the (?:south|north|east|west)|believers|muslims|jews|blacks|black people|gays|gypsies|christians|those people)"

#: (name, +1 for a voice for harm or -1 for one against, category, pattern).
VOTERS: list[tuple[str, int, str, str]] = [
    ("zh_noun", 1, "insult", "|".join(_ZH_NOUNS)),
    ("zh_noun_aimed", 1, "insult", rf"(?:你|您|楼上|楼主|up主|主播|评论区|弹幕里|@\S+ |闭嘴|滚|讲成这样|这种人|那种人|某些人)[^。！？!?\n]{{0,14}}(?:{'|'.join(_ZH_NOUNS)})|(?:{'|'.join(_ZH_NOUNS)})[^。！？!?\n]{{0,8}}(?:滚|闭嘴|去死|你)"),
    ("zh_noun_row", 1, "insult", rf"(?:(?:{'|'.join(_ZH_NOUNS)})\W?){{2,}}"),
    ("zh_idiom", 1, "insult", "猪都比你|狗都比你|算什么东西|算个什么东西|把脑子(?:忘|落|丢)|你(?:有没有|没有?)脑子|没脑子的|丢人现眼|(?:你|他|她)[^。！？!?\n]{0,10}(?:想吐|恶心)|还好意思|滚回你的|闭嘴吧|你(?:妈|娘|爹|全家)[^。！？!?\n]{0,12}(?:死|生你|脑子)|不要脸|你们?(?:就|真|都|这)?是?[个种]?垃圾|才学不会|没一个正常人"),
    ("zh_die", 1, "insult", "去死吧|赶紧去死|怎么不去(?:死|跳楼|自杀)|少你一个|死全家|你妈死了|活着就是浪费|操你妈|你[^。！？!?\n]{0,6}去死"),
    ("zh_away", 1, "insult", "滚出去|滚蛋|赶紧注销|给我滚|滚远点"),
    ("zh_threat", 1, "threat", "(?:弄死|打死|砍死|杀了|宰了|捅死|掐死|揍死|收拾)(?:你|他|她|你们)|打烂|断(?:手|腿|你)|躺进医院|带刀|见一次打一次|烧成灰|打断你|让你(?:好看|消失|后悔)|拿刀|炸了你"),
    ("zh_stalk", 1, "threat", "(?:知道|清楚|查到)[^。！？!?\n]{0,4}你(?:家|住|妈|女儿|儿子|孩子)|你(?:家|住哪|女儿|儿子|孩子|老婆)[^。！？!?\n]{0,10}(?:都?清楚|都?知道)|(?:线下|路上|现实)(?:里)?(?:碰到|遇到|见到)你|你(?:给我)?等着|给我小心"),
    ("zh_wish", 1, "threat", "希望你[^。！？!?\n]{0,12}(?:死|烧|完蛋|消失)|真该有人|再(?:多嘴|发一期|说一句)[^。！？!?\n]{0,12}(?:就|让)|少你一个世界"),
    ("zh_group", 1, "hate", rf"(?:{_GROUP_ZH})[^。！？!?\n]{{0,10}}(?:蛀虫|畜生|垃圾|寄生虫|清理|赶出去|滚出|滚回|低人一等|不配|没有?脑子|又懒又|偷|臭|恶心|素质低|不是人|脏了|该死|蟑螂|老鼠|去死)"),
    ("zh_group_rear", 1, "hate", rf"(?:清理|恶心|不收|讨厌|赶走|消灭|杀光|看到|自从|一听口音就是|早晚要把)[^。！？!?\n]{{0,8}}(?:{_GROUP_ZH})[^。！？!?\n]{{0,14}}(?:清理|臭|畜生|恶心|垃圾堆|不是人|素质|滚|赶)"),
    ("zh_degrade", 1, "hate", "都是蛀虫|统统赶出去|清理干净|天生(?:又懒|低人|下贱)|低人一等|一股臭味|一群畜生|不是人|别脏了我们|成了垃圾堆|什么都是浪费|谁信谁傻"),
    ("zh_sexual", 1, "sexual", "|".join(_ZH_SEXUAL)),
    ("zh_sexual_act", 1, "sexual", "(?:衣服|裤子|内裤|内衣)[^。！？!?\n]{0,2}脱|脱(?:了|光)[^。！？!?\n]{0,6}(?:看看|床|教你)|我都?硬了|湿了[，,]|干我|上(?:了)?她|上她|求他再深|深一点|床上[^。！？!?\n]{0,6}(?:脱|教|呻)|随便脱|玩一整晚|自己玩|看全套"),
    ("zh_solicit", 1, "sexual", "加薇|加私聊|加我私聊|成人视频|激情直播|点头像|进群看|妹子随便|发张[裸果]照|课程费我出|约吗"),
    ("en_noun", 1, "insult", rf"\b(?:{'|'.join(n for n in _EN_NOUNS if n not in ('pig', 'rat', 'clown', 'donkey', 'prick'))})(?:e?s)?\b"),
    ("en_phrase", 1, "insult", rf"\b(?:{'|'.join(_EN_PHRASES)})s?\b"),
    ("en_aimed", 1, "insult", rf"\b(?:you|your|u|uploader|shut up|crawl back|go back to|@[\w. ]+)\b[^.!?\n]{{0,40}}\b(?:{'|'.join(_EN_NOUNS)}|trash|worthless|pathetic|oxygen|brain-?dead)(?:e?s)?\b"),
    ("en_idiom", 1, "insult", r"\bshut up\b|\bshut your\b|makes? me (?:vomit|sick|puke)|delete your account|excuse for a human|what an? \w+(?:[ -]\w+){0,2} you are"),
    ("en_row", 1, "insult", rf"(?:\b(?:{'|'.join(_EN_NOUNS)}|worthless|pathetic|braying|brain-?dead)\b\W*){{2,}}"),
    ("en_threat", 1, "threat", r"smash your|beat(?:en)? (?:you|until)|deserve to be beaten|kill you\b|\b(?:bring|have) a knife|end up in a (?:ditch|hospital|grave)|you will be sorry|watch your back|hope you (?:die|burn|rot)|break your (?:legs|arms|neck|face)|stab you|shoot you|i will find you"),
    ("en_stalk", 1, "threat", r"know (?:your (?:street|address)|where you live)|your (?:daughter|son|family|kids?) (?:goes|go|lives?)\b|next time i see \w|\bor else\b|keep talking and you"),
    ("en_wish", 1, "threat", r"jump off a|nobody would miss you|if you were gone|kill yourself|just do it already|do us all a favor|go and die\b|hang yourself|drink bleach"),
    ("en_group", 1, "hate", rf"\b{_GROUP_EN}\b[^.!?\n]{{0,40}}\b(?:vermin|parasites?|animals|rats|cockroaches|thrown out|stink|lazy|thieving|no brain|not even human|subhuman|leave|crawled|breed|scum|filth|trash|cannot learn|inferior)\b"),
    ("en_group_rear", 1, "hate", rf"\b(?:get rid of|keep|if you let|not trust any of those|only good thing about|typical|was clean before|no|ban all|exterminate|deport all)\s+(?:the |those )?{_GROUP_EN}\b[^.!?\n]{{0,50}}(?:once and for all|away|vote|breed|leave|lazy|crawled|stink|animals|human|out)"),
    ("en_degrade", 1, "hate", r"not even human|are vermin|they are animals|should be thrown out|they stink"),
    ("en_sexual", 1, "sexual", r"\bnudes?\b|\bhorny\b|\btits\b|\bcasual sex\b|\bdirty pics\b|\bpanties\b|strip and moan|naked (?:on|and|in|with)\b|get naked|\bi am wet\b|play with myself|do (?:her|him|you) all night|uncensored|blow ?job|\bsexy (?:pics|photos|girls)\b|\bporn\b|cum (?:on|in)\b"),
    ("en_solicit", 1, "sexual", r"send me (?:nudes|pics|photos of)|message me with pics|link in my profile|swap \w+ pics|show us your|want you naked|private videos are|bend over"),
    ("de_insult", 1, "insult", r"halt die (?:fresse|klappe|schnauze)|vollidiot|arschloch|hurensohn|wichser|missgeburt|\bdu (?:\w+ )?(?:idiot|schwein|sau|penner|opfer)\b|verpiss dich|dumme (?:kuh|sau)"),
    ("de_other", 1, "hate", r"ungeziefer|(?:ausländer|flüchtlinge|frauen|behinderte)\b.{0,20}(?:raus|parasiten|dreck|abschaum|dumm)|alle raus\b|ich bring dich um|ich weiß,? wo du wohnst"),
    ("de_sexual", 1, "sexual", r"nacktbilder|nacktfotos|schlampe|\bnutte\b|fick mich|geile? (?:titten|sau|schlampe)"),
    ("fr_insult", 1, "insult", r"ferme[ -]la|ta gueule|connard|connasse|espèce de (?:con|connard|merde|idiot|crétin|\w+ inutile)|enculé|fils de pute|abruti|va crever|va mourir"),
    ("fr_other", 1, "hate", r"(?:étrangers|immigrés|femmes|arabes|juifs|noirs|handicapés)\b.{0,16}(?:parasites|dehors|vermine|animaux|inférieur)|je vais te (?:tuer|frapper|crever)|je sais où tu (?:habites|vis)"),
    ("fr_sexual", 1, "sexual", r"salope|\bpute\b|photos? de toi nue|toute nue|baise[- ]moi|suce[- ]moi"),
    ("es_insult", 1, "insult", r"imbécil|gilipollas|cabrón|hijo de puta|deberías morirte|muérete|cállate,? (?:idiota|estúpid|imbécil)|pedazo de mierda|eres un[a]? (?:idiota|basura|mierda|inútil|imbécil|estúpid)"),
    ("es_other", 1, "hate", r"(?:mujeres|extranjeros|inmigrantes|negros|judíos|gitanos|discapacitados)\b.{0,60}(?:basura|no sirven|parásitos|ratas|animales|fuera)|son basura|te voy a (?:matar|pegar|romper)|sé dónde vives"),
    ("es_sexual", 1, "sexual", r"\bzorra\b|fotos? (?:tuyas )?desnuda|desnúdate|mándame fotos|\bputa\b|quiero follar"),
    ("ru_insult", 1, "insult", r"заткнись|тупая|тупой (?:урод|идиот|козел)|мразь|\bсука\b|дебил|ублюдок|\bурод\b|сдохни|тварь|идиот(?:ка)?\b"),
    ("ru_other", 1, "hate", r"(?:приезжие|мигранты|женщины|евреи|чурки|инвалиды)\b.{0,20}(?:паразиты|гнать|мусор|тараканы|твари|вон)|гнать их|я тебя (?:убью|найду)|знаю,? где ты жив[её]шь"),
    ("ru_sexual", 1, "sexual", r"шлюха|голые фото|голую|скинь голые|раздевайся|трахни|\bсиськи\b"),
    ("ja_insult", 1, "insult", r"クズ|死ね|殺すぞ|ぶっ殺|ゴミ(?:野郎|人間)|バカ野郎|馬鹿野郎|キモいんだよ|消えろ|くたばれ"),
    ("ja_other", 1, "hate", r"(?:外人|外国人|女|老人|障害者|移民)は.{0,8}(?:ゴキブリ|虫|ゴミ|害虫|クズ|出て行け|劣)|ゴキブリだ|出て行け|家を知って"),
    ("ja_sexual", 1, "sexual", r"裸の写真|エロい|おっぱい|ヤらせろ|セックス|脱げよ"),
    ("ko_insult", 1, "insult", r"쓰레기는|같은 쓰레기|죽어버려|병신|개새끼|꺼져|죽여버|멍청한 (?:놈|년)|닥쳐"),
    ("ko_other", 1, "hate", r"(?:외국인|여자|노인|장애인|이민자)(?:은|는|들은).{0,10}(?:벌레|쓰레기|내쫓|짐승|열등)|벌레니까|다 내쫓|어디 사는지 알"),
    ("ko_sexual", 1, "sexual", r"벗은 사진|야한|알몸|섹스|가슴 보여"),
    ("ar_harm", 1, "insult", r"اخرس|يا (?:حمار|كلب|غبي|حقير|عاهرة|خنزير)|سأقتلك|عاهرة|صور(?:ك)? (?:ال)?عارية|(?:الأجانب|النساء|المهاجرون).{0,16}(?:حشرات|قذارة|حيوانات|اطردوهم)"),
    ("th_harm", 1, "insult", r"ไอ้(?:โง่|ควาย|สัตว์|เลว|ชาติหมา)|อีดอก|อีตัว|หุบปาก|ไปตายซะ|ฆ่ามึง|รูปโป๊|รูปเปลือย|(?:ต่างชาติ|ผู้หญิง).{0,12}(?:แมลง|ขยะ|ออกไป)"),
    ("hi_harm", 1, "insult", r"कमीने|हरामी|हरामज़ादे|कुत्ते|चुप कर|मर जा|मार डालूंगा|नंगी|रंडी|(?:विदेशी|औरतें|महिलाएं).{0,16}(?:कीड़े|कचरा|भगाओ)"),
    # Voices against.
    ("calm_topic", -1, "", r"歧视是|话题|不可随便|互相骂|骂人|不要[^。！？\n]{0,10}骂|二字|hate speech|is a topic|topic of this|stop calling|deserves? to be told|deleted those|删(?:了|掉)[^。！？\n]{0,6}(?:评论|弹幕)|举报|please do not call"),
    ("calm_technical", -1, "", r"进程|杀毒|渲染|染色体|乳腺|傻瓜式|变态辣|最终boss|chromosome|breast tissue|strip the wires|cocktail|grape|废物利用|裸眼|花盆|medical|biology|生物课|医学|解剖|kill(?:ed)? the process"),
    ("calm_coarse", -1, "", r"笑死我|哈哈|\blol\b|stupid bug|damn good|killed me \w+ times|我这[^。！？\n]{0,8}(?:垃圾|废物)|(?:render|idea|code|result|draft|video|mix) was (?:trash|garbage|worthless|crap)|(?:代码|结果|画质|软件|电脑|渲染|剪辑)[^。！？\n]{0,4}(?:垃圾|烂)"),
]
CATEGORIES = ("insult", "threat", "hate", "sexual")
#: English words also end where writing without blanks goes on in another script.
_PATTERNS = [re.compile(p, re.A if n.startswith("en_") else 0) for n, _, _, p in VOTERS]
_SIGN = np.array([s for _, s, _, _ in VOTERS])
_HARM = _SIGN > 0


def required(pattern: str) -> set[str]:
    """Literals of which any match of the pattern holds at least one, as long ones as can be told."""

    def spelled(items) -> set[str] | None:
        """All strings a short sequence can be, or None."""
        out = {""}
        for item in items:
            more = one(item)
            if more is None or len(out) * len(more) > 400:
                return None
            out = {a + b for a in out for b in more}
        return out

    def one(item) -> set[str] | None:
        op, arg = str(item[0]), item[1]
        if op == "LITERAL":
            return {chr(arg)}
        if op == "IN" and len(arg) <= 8 and all(str(k) == "LITERAL" for k, _ in arg):
            return {chr(v) for _, v in arg}
        if op == "SUBPATTERN":
            return spelled(arg[3])
        if op == "BRANCH":
            each = [spelled(b) for b in arg[1]]
            return None if any(e is None for e in each) else set().union(*each)
        if op == "MAX_REPEAT" and arg[1] == 1:
            inner = spelled(arg[2])
            return None if inner is None else inner | ({""} if arg[0] == 0 else set())
        return None

    def need(items) -> set[str] | None:
        best: set[str] | None = None

        def offer(some: set[str] | None) -> None:
            nonlocal best
            if some and "" not in some and (best is None or (min(map(len, some)), -len(some)) > (min(map(len, best)), -len(best))):
                best = some

        run: set[str] = {""}
        for item in items:
            more = one(item)
            if more is not None and len(run) * len(more) <= 400:
                run = {a + b for a in run for b in more}
                offer(run)
                continue
            offer(run)
            run = {""} if more is None else more
            op, arg = str(item[0]), item[1]
            if op == "SUBPATTERN":
                offer(need(arg[3]))
            elif op == "BRANCH":
                each = [need(b) for b in arg[1]]
                offer(None if any(e is None for e in each) else set().union(*each))
            elif op == "MAX_REPEAT" and arg[0] >= 1:
                offer(need(arg[2]))
        offer(run)
        return best

    found = need(re._parser.parse(pattern))
    if not found:
        raise ValueError(f"no literal is required by {pattern!r}")
    return found


def _automaton():
    """Required literals -> the voters to ask, as an Aho-Corasick automaton."""
    import ahocorasick

    asks: dict[str, list[int]] = {}
    for k, (*_, p) in enumerate(VOTERS):
        for w in required(p):
            asks.setdefault(w, []).append(k)
    made = ahocorasick.Automaton()
    for w, ks in asks.items():
        made.add_word(w, ks)
    made.make_automaton()
    return made


_TRIGGERS = None

# ---------------------------------------------------------------- disguise
_SEP = r"[\s*/丨|.·•_~\-]"
_FOREIGN = re.compile(f"[{''.join(TO_LATIN)}]")
_MIXED_TOKEN = re.compile(r"[a-zͰ-ԯ]*[a-z][a-zͰ-ԯ]*")
_TWINS = {ord(c): t for c, t in TO_LATIN.items()}
_LEET = str.maketrans("013457@$!|", "oieastasil")
_VOCAB = {w for w in re.findall(r"[a-z]{2,}", " ".join([*_EN_NOUNS, *_EN_PHRASES, *_EN_OTHER, *(p for n, _, _, p in VOTERS if n.startswith("en_"))]).lower())}
_VOCAB |= {w + "s" for w in _EN_NOUNS}
_SPELT = re.compile(r"(?<![a-z0-9])(?:[a-z]([ .\-])(?:[a-z]\1)+[a-z])(?![a-z0-9])")
_LEETED = re.compile(r"(?<![\w@$])(?=[a-z0-9@$!|]*[0-9@$!|])(?=[a-z0-9@$!|]*[a-z])[a-z0-9@$!|]{3,}")
_THRICE = re.compile(r"([a-z])\1\1")
_DRAWN = re.compile(r"\b\w*([a-z])\1\1\w*\b")
_MASKED = re.compile(r"(?<![a-z])[a-z]\*{2,}[a-z](?![a-z])")
_QUOTED = re.compile(r"“[^“”\n]+”|\"[^\"\n]+\"|「[^「」\n]+」|«[^«»\n]+»|„[^„“\n]+“|《[^《》\n]+》")


def _han_disguise() -> tuple[re.Pattern, dict[str, str]]:
    """Pattern of the disguised forms of the Chinese words: separators between characters, pinyin for some of them."""
    alts, back = [], {}
    for k, w in enumerate([*_ZH_NOUNS, *_ZH_SEXUAL]):
        each = [f"(?:{c}|{_PINYIN[c]})" if c in _PINYIN else c for c in w]
        alts.append(f"(?P<w{k}>{f'{_SEP}{{0,2}}'.join(each)})")
        back[f"w{k}"] = w
    # Only where a word may begin: with its first character, or with pinyin that no Latin letter comes before.
    first = "".join(sorted({w[0] for w in back.values()}))
    spelt = "|".join(sorted({_PINYIN[w[0]] for w in back.values() if w[0] in _PINYIN}))
    return re.compile(f"(?=[{first}]|(?<![a-z])(?:{spelt}))(?:{'|'.join(alts)})"), back


_HAN, _HAN_BACK = _han_disguise()
_HAN_HINT = re.compile(rf"[一-鿿]{_SEP}+[一-鿿]|[a-z][一-鿿]|[一-鿿][a-z]")
_INITIAL = re.compile(rf"(?<![a-z0-9])(?:{'|'.join(_INITIALS)})(?![a-z0-9])")


def unmask(text: str) -> str:
    """The text in small letters, look-alikes and usual disguises of words undone where a word of the lexicon results."""
    t = compatible(text).lower()
    if _FOREIGN.search(t):
        t = _MIXED_TOKEN.sub(lambda m: m[0].translate(_TWINS), t)
    if not t.isascii() and _HAN_HINT.search(t):
        t = _HAN.sub(lambda m: _HAN_BACK[m.lastgroup], t)
        t = _INITIAL.sub(lambda m: _INITIALS[m[0]] if re.search("[一-鿿]", t) else m[0], t)
    t = _SPELT.sub(lambda m: re.sub(r"[ .\-]", "", m[0]), t)
    if re.search(r"[0-9@$!|]", t):
        t = _LEETED.sub(lambda m: _unleeted(m[0]), t)
    if _THRICE.search(t):
        t = _DRAWN.sub(lambda m: _undrawn(m[0]), t)
    if "**" in t:
        t = _MASKED.sub(lambda m: _unmasked(m[0]), t)
    return t


def _unleeted(token: str) -> str:
    """The word a token of letters, digits and signs stands for, if the lexicon has it; marks at its end stay."""
    core = token.rstrip("!|")
    word = _known(core.translate(_LEET))
    return word + token[len(core) :] if word else token


def _known(word: str) -> str:
    if word in _VOCAB:
        return word
    other = word.replace("i", "l")
    return other if other in _VOCAB else ""


def _undrawn(word: str) -> str:
    one, two = re.sub(r"([a-z])\1\1+", r"\1", word), re.sub(r"([a-z])\1\1+", r"\1\1", word)
    return two if two in _VOCAB and one not in _VOCAB else one


_BY_ENDS: dict[tuple[str, str, int], str] = {}
for _w in sorted(_VOCAB, key=lambda w: (w not in _EN_NOUNS, w), reverse=True):
    _BY_ENDS[_w[0], _w[-1], len(_w)] = _w


def _unmasked(word: str) -> str:
    return _BY_ENDS.get((word[0], word[-1], len(word)), word)


# ---------------------------------------------------------------- units and votes
_PREFIX = re.compile(r"^(?:[->#*\s]+|\d+\.\s+|\[\d{1,3}:\d\d\]\s*|回复\s*@\S+\s*[:：]\s*)+")
_UNSPACED = re.compile(r"[぀-ヿ一-鿿฀-๿]")


#: A remark ends at a mark; one too many does no harm here, so titles are the only abbreviations looked at.
_END = re.compile(r"[。！？!?؟।]\s*|\.\s+")
_TITLES = ("mr", "ms", "dr", "prof", "j", "k")


def _sentences(line: str) -> list[str]:
    out, at = [], 0
    for m in _END.finditer(line):
        if m[0][0] == ".":
            word = line[max(at, m.start() - 5) : m.start()].rpartition(" ")[2]
            if word in _TITLES:
                continue
        out.append(line[at : m.end()])
        at = m.end()
    out.append(line[at:])
    return out


def remarks(text: str) -> list[str]:
    """Sentences of the unmasked text, line by line; quoted stretches become one mark."""
    out = []
    for line in unmask(text).split("\n"):
        line = _PREFIX.sub("", line).strip()
        if not line:
            continue
        for u in _sentences(_QUOTED.sub("\x01", line)):
            if u := u.strip():
                out += _windows(u) if len(u) > 80 else [u]
    return out


def _windows(unit: str) -> list[str]:
    """A sentence, or the stretches of one too long to be a sentence: around each voice for harm, and what lies between.

    Speech without punctuation would else drown a remark in its surroundings, or hide it behind a calm word far away.
    """
    size, margin = (60, 24) if _UNSPACED.search(unit) else (240, 60)
    if len(unit) <= max(80, size):
        return [unit]
    hits = sorted(m.span() for k in votes(unit) if _SIGN[k] > 0 for m in _PATTERNS[k].finditer(unit))
    spans: list[list[int]] = []
    for a, b in hits:
        a, b = max(0, a - margin), min(len(unit), b + margin)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    out, at = [], 0
    for a, b in [*spans, [len(unit), len(unit)]]:
        out += [unit[i : min(i + size, a)] for i in range(at, a, size)]
        if b > a:
            out.append(unit[a:b])
        at = max(at, b)
    return [u.strip() for u in out if u.strip()]


def votes(unit: str) -> list[int]:
    """Numbers of the voters that speak up on a remark."""
    global _TRIGGERS
    if _TRIGGERS is None:
        _TRIGGERS = _automaton()
    asked: set[int] = set()
    for _, ks in _TRIGGERS.iter(unit):
        asked.update(ks)
    return [k for k in sorted(asked) if _PATTERNS[k].search(unit)] if asked else []


# ---------------------------------------------------------------- label model
#: Fixed values the estimates start from, each with the weight of so many remarks: a voice for harm is right more often
#: than not, a voice against speaks seldom beside harm and often beside what only sounds like it.
_START_RIGHT, _RIGHT_FIRINGS, _START_BESIDE, _BESIDE_FIRINGS, _START_SHARE = 0.8, 10.0, (0.4, 0.005), 100.0, 0.01


@dataclass
class LabelModel:
    """A generative model of who speaks on a remark, given whether it is harmful.

    `share` of the remarks are harmful. A voice for harm speaks on a harmful remark with probability speaks[1], on
    another with speaks[0]; `right` is what follows, how often it is right. Voices for harm that speak together more
    than chance has it (`alike`, a correlation) share their weight. Voices against depend on whether a voice for harm
    is heard: then each speaks with probability beside[1] or beside[0], else all are quiet; alone they tell nothing.
    """

    share: float
    right: np.ndarray
    speaks: np.ndarray
    beside: np.ndarray
    alike: np.ndarray

    def probability(self, fired: np.ndarray) -> np.ndarray:
        """Probability of harm of rows x voters (0/1)."""
        harm = fired * _HARM
        loud = harm.any(axis=1)
        base = np.log(self.share / (1 - self.share))
        silent = (np.log1p(-self.speaks[1]) - np.log1p(-self.speaks[0]))[_HARM].sum()
        right = np.clip(self.right, 1e-6, 1 - 1e-6)
        gain = np.where(_HARM, np.log(right / (1 - right)) - base, 0)
        b = np.clip(self.beside, 1e-9, 1 - 1e-9)
        some = np.clip(b[:, ~_HARM].sum(axis=1), 0, 0.95)
        quiet = np.log1p(-some[1]) - np.log1p(-some[0])
        calm = fired * ~_HARM
        against = np.where(calm.any(axis=1), (calm * (np.log(b[1]) - np.log(b[0]))).sum(axis=1), quiet)
        z = base + np.where(loud, (harm * gain / (1 + harm @ self.alike)).sum(axis=1) + against, silent)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _matrix(patterns: list[str]) -> np.ndarray:
    out = np.zeros((len(patterns), len(VOTERS)))
    for r, p in enumerate(patterns):
        if p:
            out[r, [int(k) for k in p.split(",")]] = 1
    return out


def _counted(fired: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums that do not depend on a model: remarks, firings, joint firings."""
    return np.concatenate([[n.sum()], n @ fired, ((fired * n[:, None]).T @ fired).ravel()])


def _expected(model: LabelModel, fired: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums under a model: harmful remarks; those on which a voice for harm speaks, harmful or not; firings by either kind."""
    p = model.probability(fired)
    loud = (fired * _HARM).any(axis=1)
    bad, good = n * p, n * (1 - p)
    return np.concatenate([[bad.sum(), bad[loud].sum(), good[loud].sum()], bad @ fired, bad[loud] @ fired[loud], good[loud] @ fired[loud]])


def fit_label_model(patterns: DataFrame, rounds: int = 15, most_local: int = 100_000) -> LabelModel:
    """Expectation maximisation over (pattern, n): what fired on a remark, and how often in all documents.

    Each round sums over the distinct patterns. Up to `most_local` of them, counted first, are summed on the driver,
    more by a pass over their table that returns one row per partition; the sums are the same.
    """
    m = len(VOTERS)
    head = patterns.limit(most_local + 1).collect()
    x, n = _matrix([r["pattern"] for r in head]), np.array([float(r["n"]) for r in head])

    def sums(make) -> np.ndarray:
        if len(head) <= most_local:
            return make(x, n)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame({"s": [make(_matrix(f["pattern"].tolist()), f["n"].to_numpy(float)).tolist()]})

        return np.sum([np.array(r["s"]) for r in patterns.mapInPandas(run, "s array<double>").toLocalIterator()], axis=0)

    nothing = LabelModel(_START_SHARE, np.where(_HARM, _START_RIGHT, 0.0), np.zeros((2, m)), np.outer(_START_BESIDE, np.ones(m)), np.zeros((m, m)))
    if not head:
        return nothing
    got = sums(_counted)
    total, fired, pair = max(got[0], 1.0), got[1 : 1 + m], got[1 + m :].reshape(m, m)
    q = fired / total
    sd = np.sqrt(np.clip(q * (1 - q), 1e-12, None))
    alike = np.clip((pair / total - np.outer(q, q)) / np.outer(sd, sd), 0, 1) * np.outer(_HARM, _HARM) * (pair > 0)
    np.fill_diagonal(alike, 0)

    def with_rates(share: float, right: np.ndarray, beside: np.ndarray) -> LabelModel:
        speaks = np.stack([(1 - right) * fired / (total * (1 - share)), right * fired / (total * share)])
        return LabelModel(share, right, np.clip(speaks, 0, 0.95), beside, alike)

    model = with_rates(nothing.share, nothing.right, nothing.beside)
    for _ in range(rounds):
        got = sums(lambda a, b, now=model: _expected(now, a, b))
        (harmful, loud_bad, loud_good), (bad, bad_beside, good_beside) = got[:3], got[3:].reshape(3, m)
        right = np.where(_HARM, (bad + _RIGHT_FIRINGS * _START_RIGHT) / (fired + _RIGHT_FIRINGS), 0.0)
        beside = np.stack([
            (good_beside + _BESIDE_FIRINGS * _START_BESIDE[0]) / (loud_good + _BESIDE_FIRINGS),
            (bad_beside + _BESIDE_FIRINGS * _START_BESIDE[1]) / (loud_bad + _BESIDE_FIRINGS),
        ])
        model = with_rates(float(np.clip(harmful / total, 1e-5, 0.5)), right, beside)
    return model


# ---------------------------------------------------------------- linear classifier
BITS = 17


def _grams(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the hashed 3- and 4-grams of characters, digits alike, blanks left out: speech recognisers
    drop them."""
    # Remarks hold no line break, so one parts them.
    codes = np.frombuffer("\n".join(["", *units]).replace(" ", "").encode("utf-32-le", "replace"), np.uint32)
    start = codes == 10
    row = np.cumsum(start) - 1
    codes = np.where((codes >= 48) & (codes < 58), 48, codes).astype(np.uint64)
    rows, feats = [], []
    for n, seed in ((3, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
        if len(codes) < n:
            continue
        h = np.zeros(len(codes) - n + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(seed)
                h ^= h >> np.uint64(29)
        inside = (row[: len(h)] == row[n - 1 :]) & ~start[: len(h)]
        rows.append(row[: len(h)][inside])
        feats.append((h[inside] >> np.uint64(64 - BITS)).astype(np.int64))
    if not rows:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(rows), np.concatenate(feats)


@dataclass
class Linear:
    """Logistic regression over hashed n-grams; it does not see the voters."""

    grams: np.ndarray
    bias: float

    def logit(self, units: list[str]) -> np.ndarray:
        row, f = _grams(units)
        n = np.bincount(row, minlength=len(units)).clip(1)
        return np.bincount(row, self.grams[f], minlength=len(units)) / np.sqrt(n) + self.bias


def fit_linear(units: list[str], target: np.ndarray, times: np.ndarray | None = None, rounds: int = 100, rate: float = 0.3, decay: float = 1e-6, lift: float = 5.0) -> Linear:
    """Adagrad over all remarks on soft labels, each as often as it occurs; a harmful one weighs `lift` times as much as another."""
    row, f = _grams(units)
    n = len(units)
    value = (1 / np.sqrt(np.bincount(row, minlength=n).clip(1)))[row]
    seen, at = np.unique(f, return_inverse=True)
    weight = (1 + (lift - 1) * target) * (1 if times is None else times)
    weight = weight / weight.sum()
    w, bias = np.zeros(len(seen)), -4.0
    gw, gb = np.full(len(seen), 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(row, w[at] * value, minlength=n) + bias
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        g = np.bincount(at, e[row] * value, minlength=len(seen)) + decay * w
        gw += g * g
        gb += e.sum() ** 2
        w -= rate * g / np.sqrt(gw)
        bias -= rate * e.sum() / np.sqrt(gb)
    grams = np.zeros(1 << BITS)
    grams[seen] = w
    return Linear(grams, float(bias))


# ---------------------------------------------------------------- operator


def _lists(flat: list, offsets: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.string()))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (..., text) to rows (..., units, votes): the remarks of each text and the voters that speak on each."""
    for b in batches:
        units: list[str] = []
        offsets = [0]
        for t in b.column(b.num_columns - 1).to_pylist():
            if t:
                units += remarks(t)
            offsets.append(len(units))
        said = [",".join(map(str, votes(u))) for u in units]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], _lists(units, offsets), _lists(said, offsets)], names=[*b.schema.names[:-1], "units", "votes"])


def read_remarks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source_key, units, votes) of every document, written to the shared folder: texts are cut and voted on once."""
    rows = docs.select(F.col(id_col).alias("doc_id"), source_key(source_col).alias("source_key"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return stage(rows.mapInArrow(_cut, f"doc_id {kind}, source_key string, units array<string>, votes array<string>"), "remarks")


def train(read: DataFrame, most_harmful: int = 15_000, most_silent: int = 25_000, most_contested: int = 10_000, sample_chars: int = 400) -> Linear:
    """The classifier of a corpus: label model over the votes of all remarks of read_remarks(), linear model on a sample.

    The linear model learns from at most `most_harmful` distinct remarks whose posterior is 0.5 or more and
    `most_contested` others on which a voter speaks, by smallest hash, each with its count; and from about
    `most_silent` occurrences of remarks on which none does, drawn by a hash of document and place, so that a remark
    that is frequent in the corpus is so in the sample. Remarks above `sample_chars` characters are not learned from.
    """
    each = read.select("doc_id", F.posexplode(F.arrays_zip("units", "votes")).alias("at", "r")).select("doc_id", "at", F.col("r.units").alias("unit"), F.col("r.votes").alias("pattern"))
    counts = stage(each.groupBy("pattern").agg(F.count("*").alias("n")), "patterns")
    model = fit_label_model(counts)

    def belief(p: pd.Series) -> pd.Series:
        return pd.Series(model.probability(_matrix(p.tolist())))

    order = [F.xxhash64("unit"), "unit"]
    some = each.where(F.length("unit") <= sample_chars)
    loud = stage(some.where("pattern <> ''").groupBy("unit", "pattern").agg(F.count("*").alias("n")).withColumn("p", F.pandas_udf(belief, "double")("pattern")), "loud")
    harmful = loud.where("p >= 0.5").orderBy(*order).limit(most_harmful).collect()
    if not harmful:
        return Linear(np.zeros(1 << BITS), -3.0)
    contested = loud.where("p < 0.5").orderBy(*order).limit(most_contested).collect()
    n_silent = next((r["n"] for r in counts.where("pattern = ''").collect()), 0)
    drawn = F.pmod(F.xxhash64("doc_id", "at"), F.lit(1 << 40)) < F.lit(min(1 << 40, (most_silent << 40) // max(n_silent, 1)))
    silent = some.where("pattern = ''").where(drawn).groupBy("unit").agg(F.count("*").alias("n")).orderBy(*order).limit(2 * most_silent).collect()
    rows = [*harmful, *contested, *silent]
    target = np.array([*(r["p"] for r in harmful), *(r["p"] for r in contested), *[0.0] * len(silent)])
    return fit_linear([r["unit"] for r in rows], target, np.array([float(r["n"]) for r in rows]))


def _scored(linear: Linear):
    """Function from rows (doc_id, source_key, units, votes) to their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy(zero_copy_only=False)
            units, said = b.column(2).flatten().to_pylist(), b.column(3).flatten()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            p = np.zeros(len(units))
            for at in range(0, len(units), 20_000):
                p[at : at + 20_000] = 1 / (1 + np.exp(-np.clip(linear.logit(units[at : at + 20_000]), -30, 30)))
            best = np.zeros(len(sizes))
            np.maximum.at(best, owner, p)
            n_bad = np.bincount(owner, p >= 0.5, minlength=len(sizes)).astype(np.int32)
            kind: list[str | None] = [None] * len(sizes)
            for i in np.flatnonzero((p >= 0.5) & (p == best[owner])):
                told = [VOTERS[int(v)][2] for v in (said[int(i)].as_py() or "").split(",") if v and VOTERS[int(v)][1] > 0]
                if told and kind[owner[i]] is None:
                    kind[owner[i]] = max(CATEGORIES, key=lambda c: (told.count(c), -CATEGORIES.index(c)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(best, pa.float64()), pa.array(best >= 0.5, pa.bool_()), pa.array(kind, pa.string()), pa.array(n_bad, pa.int32())],
                names=["doc_id", "source_key", "score", "is_harmful", "category", "n_remarks"],
            )

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", model: Linear | None = None) -> DataFrame:
    """doc_id, source_key, score (the worst remark's probability), is_harmful (0.5 or more), category, n_remarks.

    Every document has a row; null and empty texts score 0. Whole texts are read, sentence by sentence. Rows with equal
    ids each have their row. `category` is null for harmless documents and where no voter explains the score. Other
    columns are ignored. The remarks are written to the shared folder once, about as large as the texts, and read to
    train and to score.
    """
    read = read_remarks(docs, id_col, text_col, source_col)
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(_scored(model or train(read)), f"doc_id {kind}, source_key string, score double, is_harmful boolean, category string, n_remarks int")


def rates(scored: DataFrame) -> DataFrame:
    """Documents, harmful ones and their rate per source; sources that are null stand under null."""
    return scored.groupBy("source_key").agg(
        F.count("*").alias("n_docs"), F.count_if("is_harmful").alias("n_harmful"), (F.count_if("is_harmful") / F.count("*")).alias("harmful_rate"), F.avg("score").alias("mean_score")
    )

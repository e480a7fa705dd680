"""Stemmers after the published Snowball algorithms: English (Porter 2), German, French, Spanish, Italian, Portuguese, Romanian,
Russian, Hungarian, Swedish, Norwegian, Danish, Dutch.

Other languages leave words as they are, as an unknown language does.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache


def _r1(word: str, vowels: str, start: int = 0) -> int:
    """The place after the first consonant that follows a vowel, from a place on."""
    m = re.search(rf"[{vowels}][^{vowels}]", word[start:])
    return start + m.end() if m else len(word)


def _longest(word: str, ends: tuple[str, ...] | list[str]) -> str:
    return max((e for e in ends if word.endswith(e)), key=len, default="")


# English

_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Fixed values of the published algorithm: words with stems of their own.
_ENGLISH_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_ENGLISH_SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_ENGLISH_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Fixed values of the published algorithm: endings of steps 2 and 3 and what they become.
_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")


def _short_syllable(word: str) -> bool:
    return bool(re.search(r"(^[aeiouy][^aeiouy]$)|([^aeiouy][aeiouy][^aeiouywxY]$)", word))


def english(word: str) -> str:
    if len(word) <= 2 or word in _ENGLISH_SAME:
        return word
    if word in _ENGLISH_WHOLE:
        return _ENGLISH_WHOLE[word]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", word.removeprefix("'"))
    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), "")
    r1 = len(head) or _r1(w, _V)
    r2 = _r1(w, _V, r1)
    w = w.removesuffix(_longest(w, ["'", "'s", "'s'"]))
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy].+s$", w):
        w = w[:-1]
    if w in _ENGLISH_AFTER_1A:
        return w
    # 1b
    end = _longest(w, ["eed", "eedly", "ed", "edly", "ing", "ingly"])
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and re.search(r"[aeiouy]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif len(w) <= r1 and _short_syllable(w):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # 2
    end = _longest(w, [*_STEP2, "ogi", "li"])
    if end and len(w) - len(end) >= r1:
        if end == "ogi":
            w = w[:-1] if w.endswith("logi") else w
        elif end == "li":
            w = w[:-2] if len(w) > 2 and w[-3] in "cdeghkmnrt" else w
        else:
            w = w[: -len(end)] + _STEP2[end]
    # 3
    end = _longest(w, [*_STEP3, "ative"])
    if end and len(w) - len(end) >= r1:
        if end == "ative":
            w = w[:-5] if len(w) - 5 >= r2 else w
        else:
            w = w[: -len(end)] + _STEP3[end]
    # 4
    end = _longest(w, [*_STEP4, "ion"])
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(end)]
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


# German


def german(word: str) -> str:
    v = "aeiouyäöü"
    w = word.replace("ß", "ss")
    w = re.sub(rf"(?<=[{v}])u(?=[{v}])", "U", w)
    w = re.sub(rf"(?<=[{v}])y(?=[{v}])", "Y", w)
    r1 = _r1(w, v)
    r2 = _r1(w, v, r1)
    r1 = max(r1, 3)
    # 1
    end = _longest(w, ["em", "ern", "er", "e", "en", "es", "s"])
    if end and len(w) - len(end) >= r1:
        if end != "s":
            w = w[: -len(end)]
            if end in ("e", "en", "es") and w.endswith("niss"):
                w = w[:-1]
        elif len(w) > 1 and w[-2] in "bdfghklmnrt":
            w = w[:-1]
    # 2
    end = _longest(w, ["en", "er", "est", "st"])
    if end and len(w) - len(end) >= r1 and (end != "st" or (len(w) > 5 and w[-3] in "bdfghklmnt")):
        w = w[: -len(end)]
    # 3
    end = _longest(w, ["end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"])
    if end and len(w) - len(end) >= r2:
        cut = w[: -len(end)]
        if end in ("end", "ung"):
            w = cut
            if w.endswith("ig") and not w.endswith("eig") and len(w) - 2 >= r2:
                w = w[:-2]
        elif end in ("ig", "ik", "isch"):
            w = w if cut.endswith("e") else cut
        elif end in ("lich", "heit"):
            w = cut
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = cut
            more = _longest(w, ["lich", "ig"])
            if more and len(w) - len(more) >= r2:
                w = w[: -len(more)]
    return w.translate(str.maketrans("äöüUY", "aouuy"))


# Spanish


def _rv(word: str, vowels: str) -> int:
    if len(word) < 3:
        return len(word)
    if word[1] not in vowels:
        m = re.search(rf"[{vowels}]", word[2:])
        return 2 + m.end() if m else len(word)
    if word[0] in vowels:
        m = re.search(rf"[^{vowels}]", word[2:])
        return 2 + m.end() if m else len(word)
    return 3


_ACUTE = str.maketrans("áéíóú", "aeiou")
#: Fixed values of the published algorithm: pronouns, and endings of its steps.
_ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
_ES_VERB_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_ES_VERB = """arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos
erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban
ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais
arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos""".split()


def spanish(word: str) -> str:
    v = "aeiouáéíóúü"
    w = word
    rv, r1 = _rv(w, v), _r1(w, v)
    r2 = _r1(w, v, r1)
    # pronouns
    end = _longest(w, _ES_PRONOUNS)
    if end and len(w) - len(end) >= rv:
        stem = w[: -len(end)]
        verb = _longest(stem, ["iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo"])
        if verb and len(stem) - len(verb) >= rv and (verb != "yendo" or stem.endswith("uyendo")):
            w = stem[: -len(verb)] + verb.translate(_ACUTE)
    start = w
    # standard endings
    groups = [
        (["anza", "anzas", "ico", "ica", "icos", "icas", "ismo", "ismos", "able", "ables", "ible", "ibles", "ista", "istas", "oso", "osa", "osos", "osas", "amiento", "amientos", "imiento", "imientos"], ""),
        (["adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias"], ""),
        (["logía", "logías"], "log"),
        (["ución", "uciones"], "u"),
        (["encia", "encias"], "ente"),
        (["amente"], ""),
        (["mente"], ""),
        (["idad", "idades"], ""),
        (["iva", "ivo", "ivas", "ivos"], ""),
    ]
    end = _longest(w, [e for g, _ in groups for e in g])
    if end:
        put = next(p for g, p in groups if end in g)
        at = len(w) - len(end)
        if end == "amente":
            if at >= r1:
                w = w[:at]
                for more in ("iv", "os", "ic", "ad"):
                    if w.endswith(more) and len(w) - len(more) >= r2:
                        w = w[: -len(more)]
                        if more == "iv" and w.endswith("at") and len(w) - 2 >= r2:
                            w = w[:-2]
                        break
        elif at >= r2:
            w = w[:at] + put
            then = {"mente": ["ante", "able", "ible"], "idad": ["abil", "ic", "iv"], "idades": ["abil", "ic", "iv"]}.get(end, [])
            if end in groups[1][0]:
                then = ["ic"]
            elif end in groups[8][0]:
                then = ["at"]
            more = _longest(w, then)
            if more and len(w) - len(more) >= r2:
                w = w[: -len(more)]
    if w == start:
        end = _longest(w, _ES_VERB_Y)
        if end and len(w) - len(end) >= rv and w[: -len(end)].endswith("u"):
            w = w[: -len(end)]
        else:
            end = _longest(w[rv:], [*_ES_VERB, "en", "es", "éis", "emos"])
            if end:
                w = w[: -len(end)]
                if end in ("en", "es", "éis", "emos") and w.endswith("gu"):
                    w = w[:-1]
    end = _longest(w[rv:], ["os", "a", "o", "á", "í", "ó", "e", "é"])
    if end:
        w = w[: -len(end)]
        if end in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_ACUTE)


# French

_FR_V = "aeiouyâàëéêèïîôûù"
#: Fixed values of the published algorithm: endings of its steps.
_FR_PLAIN = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
_FR_AGENT = "atrice ateur ation atrices ateurs ations".split()
_FR_OTHER = "logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments".split()
_FR_I = """îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait
issant issante issantes issants isse issent isses issez issiez issions issons it""".split()
_FR_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_FR_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def _french_rv(w: str) -> int:
    if w.startswith(("par", "col", "tap")):
        return 3
    if len(w) > 1 and w[0] in _FR_V and w[1] in _FR_V:
        return min(3, len(w))
    m = re.search(rf"[{_FR_V}]", w[1:])
    return 1 + m.end() if m else len(w)


def _french_ending(w: str, rv: int, r1: int, r2: int) -> tuple[str, bool]:
    """(word, whether verb endings are to be tried) after the standard endings."""
    end = _longest(w, [*_FR_PLAIN, *_FR_AGENT, *_FR_OTHER])
    if not end:
        return w, True
    at = len(w) - len(end)
    cut = w[:at]

    def less(x: str, more: str, other: str | None = None) -> str:
        """Takes a further ending off if it is far enough in, or puts another one."""
        if not x.endswith(more):
            return x
        head = x[: -len(more)]
        return head if len(head) >= r2 else x if other is None else head + other

    if end in _FR_PLAIN:
        return (cut, False) if at >= r2 else (w, True)
    if end in _FR_AGENT:
        return (less(cut, "ic", "iqU"), False) if at >= r2 else (w, True)
    put = {"logie": "log", "logies": "log", "usion": "u", "ution": "u", "usions": "u", "utions": "u", "ence": "ent", "ences": "ent"}
    if end in put:
        return (cut + put[end], False) if at >= r2 else (w, True)
    if end in ("ement", "ements"):
        if at < rv:
            return w, True
        if cut.endswith("iv"):
            shorter = less(cut, "iv")
            return (less(shorter, "at") if shorter != cut else cut), False
        if cut.endswith("eus"):
            return (cut[:-3] if at - 3 >= r2 else cut[:-1] + "x" if at - 3 >= r1 else cut), False
        if cut.endswith(("abl", "iqU")):
            return (cut[:-3] if at - 3 >= r2 else cut), False
        if cut.endswith(("ièr", "Ièr")):
            return (cut[:-3] + "i" if at - 3 >= rv else cut), False
        return cut, False
    if end in ("ité", "ités"):
        if at < r2:
            return w, True
        return (less(cut, "abil", "abl") if cut.endswith("abil") else less(cut, "ic", "iqU") if cut.endswith("ic") else less(cut, "iv")), False
    if end in ("if", "ive", "ifs", "ives"):
        if at < r2:
            return w, True
        shorter = less(cut, "at")
        return (less(shorter, "ic", "iqU") if shorter != cut else cut), False
    if end == "eaux":
        return w[:-1], False
    if end == "aux":
        return (cut + "al", False) if at >= r1 else (w, True)
    if end in ("euse", "euses"):
        return (cut, False) if at >= r2 else (cut + "eux", False) if at >= r1 else (w, True)
    if end in ("issement", "issements"):
        return (cut, False) if at >= r1 and cut and cut[-1] not in _FR_V else (w, True)
    if end in ("amment", "emment"):
        return (cut + ("ant" if end == "amment" else "ent"), True) if at >= rv else (w, True)
    return (cut, True) if at - 1 >= rv and cut[-1] in _FR_V else (w, True)


def french(word: str) -> str:
    v = _FR_V
    w = re.sub("(?<=q)u", "U", word)
    w = re.sub(rf"(?<=[{v}])([ui])(?=[{v}])", lambda m: m[1].upper(), w)
    w = re.sub(rf"(?<=[{v}])y|y(?=[{v}])", "Y", w)
    rv, r1 = _french_rv(w), _r1(w, v)
    r2 = _r1(w, v, r1)
    start = w
    w, verbs = _french_ending(w, rv, r1, r2)
    if verbs:
        before = w
        end = _longest(w[rv:], _FR_I)
        at = len(w) - len(end)
        if end and at - 1 >= rv and w[at - 1] not in v:
            w = w[:at]
        if w == before:
            end = _longest(w[rv:], ["ions", *_FR_E, *_FR_A])
            at = len(w) - len(end)
            if end == "ions":
                w = w[:at] if at >= r2 else w
            elif end:
                w = w[:at]
                if end in _FR_A and w.endswith("e") and at - 1 >= rv:
                    w = w[:-1]
    if w != start:
        w = w[:-1] + "i" if w.endswith("Y") else w[:-1] + "c" if w.endswith("ç") else w
    else:
        if w.endswith("s") and len(w) > 1 and w[-2] not in "aiouès":
            w = w[:-1]
        end = _longest(w[rv:], ["ion", "ier", "ière", "Ier", "Ière", "e", "ë"])
        at = len(w) - len(end)
        if end == "ion":
            w = w[:at] if at >= r2 and at - 1 >= rv and w[at - 1] in "st" else w
        elif end == "ë":
            w = w[:at] if w[:at].endswith("gu") else w
        elif end:
            w = w[:at] + ("" if end == "e" else "i")
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    w = re.sub(rf"[éè]([^{v}]+)$", r"e\1", w)
    return w.lower()


# Scandinavian languages and Dutch


def _scandinavian(word: str, vowels: str, ends: list[str], s_after: str, then: Callable[[str, int], str]) -> str:
    r1 = max(_r1(word, vowels), 3)
    end = _longest(word[r1:], [*ends, "s"])
    if end == "s":
        if len(word) > 1 and re.search(rf"[{s_after}]s$|[^{vowels}]ks$" if "k" not in s_after else rf"[{s_after}]s$", word):
            word = word[:-1]
    elif end:
        word = word[: -len(end)]
    return then(word, r1)


def swedish(word: str) -> str:
    ends = "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast".split()

    def then(w: str, r1: int) -> str:
        if _longest(w[r1:], ["dd", "gd", "nn", "dt", "gt", "kt", "tt"]):
            w = w[:-1]
        end = _longest(w[r1:], ["lig", "ig", "els", "löst", "fullt"])
        return w[:-1] if end in ("löst", "fullt") else w.removesuffix(end) if end else w

    return _scandinavian(word, "aeiouyäåö", ends, "bcdfghjklmnoprtvy", then)


def danish(word: str) -> str:
    ends = "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret".split()

    def then(w: str, r1: int) -> str:
        double = lambda x: x[:-1] if _longest(x[r1:], ["gd", "dt", "gt", "kt"]) else x
        w = double(w)
        if w.endswith("igst"):
            w = w[:-2]
        end = _longest(w[r1:], ["ig", "lig", "elig", "els", "løst"])
        if end == "løst":
            w = w[:-1]
        elif end:
            w = double(w[: -len(end)])
        return w[:-1] if len(w) > r1 and len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiouyæåø" else w

    return _scandinavian(word, "aeiouyæåø", ends, "abcdfghjklmnoprtvyzå", then)


def norwegian(word: str) -> str:
    ends = "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast".split()

    def then(w: str, r1: int) -> str:
        if _longest(w[r1:], ["dt", "vt"]):
            w = w[:-1]
        end = _longest(w[r1:], ["leg", "eleg", "ig", "eig", "lig", "elig", "els", "lov", "elov", "slov", "hetslov"])
        return w.removesuffix(end) if end else w

    for end in ("ert", "erte"):
        r1 = max(_r1(word, "aeiouyæåø"), 3)
        if word.endswith(end) and len(word) - len(end) >= r1:
            return then(word[: -len(end)] + "er", r1)
    return _scandinavian(word, "aeiouyæåø", ends, "bcdfghjlmnoprtvyz", then)


def dutch(word: str) -> str:
    v = "aeiouyè"
    w = word.translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    w = re.sub(rf"^y|(?<=[{v}])y", "Y", w)
    w = re.sub(rf"(?<=[{v}])i(?=[{v}])", "I", w)
    r1 = _r1(w, v)
    r2 = _r1(w, v, r1)
    r1 = max(r1, 3)
    undouble = lambda x: x[:-1] if x.endswith(("kk", "dd", "tt")) else x
    consonant = lambda x: bool(x) and x[-1] not in v
    end = _longest(w, ["heden", "ene", "en", "se", "s"])
    at = len(w) - len(end)
    if end == "heden" and at >= r1:
        w = w[:at] + "heid"
    elif end in ("ene", "en") and at >= r1 and consonant(w[:at]) and not w[:at].endswith("gem"):
        w = undouble(w[:at])
    elif end in ("se", "s") and at >= r1 and consonant(w[:at]) and w[at - 1] != "j":
        w = w[:at]
    dropped = False
    if w.endswith("e") and len(w) - 1 >= r1 and consonant(w[:-1]):
        w, dropped = undouble(w[:-1]), True
    if w.endswith("heid") and len(w) - 4 >= r2 and not w[:-4].endswith("c"):
        w = w[:-4]
        if w.endswith("en") and len(w) - 2 >= r1 and consonant(w[:-2]) and not w[:-2].endswith("gem"):
            w = undouble(w[:-2])
    end = _longest(w, ["end", "ing", "ig", "lijk", "baar", "bar"])
    at = len(w) - len(end)
    if end and at >= r2:
        if end in ("end", "ing"):
            w = w[:at]
            w = w[:-2] if w.endswith("ig") and len(w) - 2 >= r2 and not w.endswith("eig") else undouble(w)
        elif end == "ig":
            w = w if w[:at].endswith("e") else w[:at]
        elif end == "lijk":
            w = w[:at]
            if w.endswith("e") and len(w) - 1 >= r1 and consonant(w[:-1]):
                w = undouble(w[:-1])
        elif end == "baar" or dropped:
            w = w[:at]
    if re.search(rf"[^{v}I](aa|ee|oo|uu)[^{v}I]$", w):
        w = w[:-2] + w[-1]
    return w.lower()


# Italian

_IT_V = "aeiouàèìòù"
#: Fixed values of the published algorithm: pronouns, endings and verb endings.
_IT_PRONOUNS = "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene".split()
_IT_PLAIN = "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti".split()
_IT_VERBS = """ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà
erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo Yamo iamo
immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero
ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir""".split()


def _less(w: str, at: int, *ends: str) -> str:
    """Without the first of some endings that begins at a place or behind it."""
    for e in ends:
        if w.endswith(e):
            return w[: -len(e)] if len(w) - len(e) >= at else w
    return w


def _italian_ending(w: str, rv: int, r1: int, r2: int) -> str:
    pairs = {"logia": "log", "logie": "log", **dict.fromkeys("uzione uzioni usione usioni".split(), "u"), "enza": "ente", "enze": "ente"}
    end = _longest(w, [*_IT_PLAIN, *pairs, *"azione azioni atore atori amento amenti imento imenti amente ità ivo ivi iva ive".split()])
    at = len(w) - len(end)
    if not end or at < (rv if end[1:] in ("mento", "menti") else r1 if end == "amente" else r2):
        return w
    w = w[:at] + pairs.get(end, "")
    if end in ("azione", "azioni", "atore", "atori"):
        return _less(w, r2, "ic")
    if end == "amente":
        return _less(_less(w, r2, "iv"), r2, "at") if w.endswith("iv") and len(w) - 2 >= r2 else _less(w, r2, "os", "ic", "abil")
    if end == "ità":
        return _less(w, r2, "abil", "ic", "iv")
    if end in ("ivo", "ivi", "iva", "ive"):
        return _less(_less(w, r2, "at"), r2, "ic") if w.endswith("at") and len(w) - 2 >= r2 else w
    return w


def italian(word: str) -> str:
    v = _IT_V
    w = re.sub("(?<=q)u", "U", word.translate(str.maketrans("áéíóú", "àèìòù")))
    w = re.sub(rf"(?<=[{v}])([ui])(?=[{v}])", lambda m: m[1].upper(), w)
    rv, r1 = _rv(w, v), _r1(w, v)
    r2 = _r1(w, v, r1)
    end = _longest(w, _IT_PRONOUNS)
    rest = w[: len(w) - len(end)]
    if end and _longest(rest[rv:], ["ando", "endo"]):
        w = rest
    elif end and _longest(rest[rv:], ["ar", "er", "ir"]):
        w = rest + "e"
    start = w
    w = _italian_ending(w, rv, r1, r2)
    if w == start:
        w = w[: len(w) - len(_longest(w[rv:], _IT_VERBS))]
    if len(w) > rv and w[-1] in "aeioàèìò":
        w = _less(w[:-1], rv, "i")
    if w.endswith(("ch", "gh")) and len(w) - 2 >= rv:
        w = w[:-1]
    return w.lower()


# Portuguese

_PT_V = "aeiouáéíóúâêô"
#: Fixed values of the published algorithm: endings and verb endings; "~" stands for the nasal sign of the vowel before it.
_PT_PLAIN = "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância".split()
_PT_VERBS = """ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam
aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias
erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis
aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos
iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras""".split()


def _portuguese_ending(w: str, rv: int, r1: int, r2: int) -> str:
    pairs = {"logia": "log", "logias": "log", "uça~o": "u", "uço~es": "u", "ência": "ente", "ências": "ente"}
    end = _longest(w, [*_PT_PLAIN, *pairs, *"amente mente idade idades iva ivo ivas ivos ira iras".split()])
    at = len(w) - len(end)
    if end in ("ira", "iras"):
        return w[:at] + "ir" if at >= rv and w[:at].endswith("e") else w
    if not end or at < (r1 if end == "amente" else r2):
        return w
    w = w[:at] + pairs.get(end, "")
    if end == "amente":
        return _less(_less(w, r2, "iv"), r2, "at") if w.endswith("iv") and len(w) - 2 >= r2 else _less(w, r2, "os", "ic", "ad")
    if end == "mente":
        return _less(w, r2, "ante", "avel", "ível")
    if end in ("idade", "idades"):
        return _less(w, r2, "abil", "ic", "iv")
    return _less(w, r2, "at") if end.startswith("iv") else w


def portuguese(word: str) -> str:
    v = _PT_V
    w = word.replace("ã", "a~").replace("õ", "o~")
    rv, r1 = _rv(w, v), _r1(w, v)
    r2 = _r1(w, v, r1)
    start = w
    w = _portuguese_ending(w, rv, r1, r2)
    if w == start:
        w = w[: len(w) - len(_longest(w[rv:], _PT_VERBS))]
    if w != start:
        w = w[:-1] if w.endswith("ci") and len(w) - 1 >= rv else w
    else:
        w = w[: len(w) - len(_longest(w[rv:], ["os", "a", "i", "o", "á", "í", "ó"]))]
    if len(w) > rv and w[-1] in "eéê":
        w = w[:-1]
        if w.endswith(("gu", "ci")) and len(w) - 1 >= rv:
            w = w[:-1]
    elif w.endswith("ç"):
        w = w[:-1] + "c"
    return w.replace("a~", "ã").replace("o~", "õ")


# Romanian

_RO_V = "aăâeiîou"
#: Fixed values of the published algorithm: endings, those of verbs in two groups.
_RO_0 = {"ul": "", "ului": "", "aua": "a", **dict.fromkeys("ea ele elor".split(), "e"), **dict.fromkeys("ii iua iei iile iilor ilor ile".split(), "i"), "atei": "at", "aţie": "aţi", "aţia": "aţi"}
_RO_1 = {
    "abil": "abilitate abilitati abilităi abilităţi", "ibil": "ibilitate", "iv": "ivitate ivitati ivităi ivităţi",
    "ic": "icitate icitati icităi icităţi icator icatori iciv iciva icive icivi icivă ical icala icale icali icală",
    "at": "ativ ativa ative ativi ativă aţiune atoare ator atori ătoare ător ători", "it": "itiv itiva itive itivi itivă iţiune itoare itor itori",
}
_RO_2 = """at ata ată ati ate ut uta ută uti ute it ita ită iti ite ic ica ice ici ică abil abila abile abili abilă ibil ibila ibile ibili
ibilă oasa oasă oase os osi oşi ant anta ante anti antă ator atori itate itati ităi ităţi iv iva ive ivi ivă""".split()
_RO_IST = "ism isme ist ista iste isti istă işti".split()
_RO_VERBS_A = """are ere ire âre ind ând indu ându eze ească ez ezi ează esc eşti eşte ăsc ăşti ăşte am ai au eam eai ea eaţi eau iam iai
ia iaţi iau ui aşi arăm arăţi ară uşi urăm urăţi ură işi irăm irăţi iră âi âşi ârăm ârăţi âră asem aseşi ase aserăm aserăţi aseră
isem iseşi ise iserăm iserăţi iseră âsem âseşi âse âserăm âserăţi âseră usem useşi use userăm userăţi useră""".split()
_RO_VERBS_B = "ăm aţi em eţi im iţi âm âţi seşi serăm serăţi seră sei se sesem seseşi sese seserăm seserăţi seseră".split()


def romanian(word: str) -> str:
    v = _RO_V
    w = word.translate(str.maketrans("șț", "şţ"))
    w = re.sub(rf"(?<=[{v}])([ui])(?=[{v}])", lambda m: m[1].upper(), w)
    rv, r1 = _rv(w, v), _r1(w, v)
    r2 = _r1(w, v, r1)
    end = _longest(w, list(_RO_0))
    at = len(w) - len(end)
    if end and at >= r1 and not (end == "ile" and w[:at].endswith("ab")):
        w = w[:at] + _RO_0[end]
    start, made = w, {e: to for to, ends in _RO_1.items() for e in ends.split()}
    while (end := _longest(w, list(made))) and len(w) - len(end) >= r1:
        w = w[: -len(end)] + made[end]
    changed = w != start
    end = _longest(w, [*_RO_2, *_RO_IST, "iune", "iuni"])
    at = len(w) - len(end)
    if end and at >= r2:
        if end in ("iune", "iuni"):
            if w[:at].endswith("ţ"):
                w, changed = w[: at - 1] + "t", True
        else:
            w, changed = w[:at] + ("ist" if end in _RO_IST else ""), True
    if not changed:
        end = _longest(w[rv:], [*_RO_VERBS_A, *_RO_VERBS_B])
        at = len(w) - len(end)
        if end and (end in _RO_VERBS_B or (at - 1 >= rv and (w[at - 1] not in v or w[at - 1] == "u"))):
            w = w[:at]
    w = w[: len(w) - len(_longest(w[rv:], ["a", "e", "i", "ie", "ă"]))]
    return w.lower()


# Russian

_RU_V = "аеиоуыэюя"
#: Fixed values of the published algorithm: endings; those of a first group only follow а or я.
_RU_GERUNDS = ("в вши вшись".split(), "ив ивши ившись ыв ывши ывшись".split())
_RU_ADJECTIVES = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
_RU_PARTICIPLES = ("ем нн вш ющ щ".split(), "ивш ывш ующ".split())
_RU_VERBS = ("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(), "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split())
_RU_NOUNS = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def _after_a(part: str, groups: tuple[list[str], list[str]]) -> str:
    """The longest ending, which of the first group has to follow а or я."""
    end = _longest(part, [*groups[0], *groups[1]])
    return end if end in groups[1] or part[: len(part) - len(end)].endswith(("а", "я")) else ""


def russian(word: str) -> str:
    w = word.replace("ё", "е")
    m = re.search(f"[{_RU_V}]", w)
    rv = m.end() if m else len(w)
    r2 = _r1(w, _RU_V, _r1(w, _RU_V))
    head, part = w[:rv], w[rv:]
    cut = lambda x, end: x[: len(x) - len(end)]
    if end := _after_a(part, _RU_GERUNDS):
        part = cut(part, end)
    else:
        part = cut(part, _longest(part, ["ся", "сь"]))
        if end := _longest(part, _RU_ADJECTIVES):
            part = cut(part, end)
            part = cut(part, _after_a(part, _RU_PARTICIPLES))
        elif end := _after_a(part, _RU_VERBS):
            part = cut(part, end)
        else:
            part = cut(part, _longest(part, _RU_NOUNS))
    part = part.removesuffix("и")
    end = _longest(part, ["ост", "ость"])
    if end and len(head) + len(part) - len(end) >= r2:
        part = cut(part, end)
    if end := _longest(part, ["ейш", "ейше"]):
        part = cut(part, end)
        part = part[:-1] if part.endswith("нн") else part
    elif part.endswith("нн"):
        part = part[:-1]
    else:
        part = part.removesuffix("ь")
    return head + part


# Hungarian

_HU_V = "aeiouáéíóöőúüű"
_HU_PAIRS = ("cs", "dz", "gy", "ly", "ny", "sz", "ty", "zs")
_HU_DOUBLE = tuple("bb cc ccs dd ff gg ggy jj kk ll lly mm nn nny pp rr ss ssz tt tty vv zz zzs".split())
#: Fixed values of the published algorithm: the endings of each step, in order: those that go, those that leave a, those that leave e.
_HU_STEPS = [
    ("ban ben ba be ra re nak nek val vel tól től ról ről ból ből hoz hez höz nál nél ig at et ot öt ért képp képpen kor ul ül vá vé onként enként anként ként en on an ön n t", "", ""),
    ("", "án ánként", "én"),
    ("astul estül stul stül", "ástul", "éstül"),
    ("", "", ""),
    ("oké öké aké eké ké éi é", "áké áéi", "éké ééi éé"),
    ("ünk unk nk juk jük uk ük em om am m od ed ad öd d ja je a e o", "ánk ájuk ám ád á", "énk éjük ém éd é"),
    ("jaim jeim aim eim im jaid jeid aid eid id jai jei ai ei i jaink jeink eink aink ink jaitok jeitek aitok eitek itek jeik jaik aik eik ik", "áim áid ái áink áitok áik", "éim éid éi éink éitek éik"),
    ("ök ok ek ak k", "ák", "ék"),
]


def hungarian(word: str) -> str:
    w, v = word, _HU_V
    if w[:1] and w[0] in v:
        m = re.search(rf"[^{v}]", w)
        r1 = (m.start() + (3 if w.startswith("dzs", m.start()) else 2 if w.startswith(_HU_PAIRS, m.start()) else 1)) if m else len(w)
    else:
        m = re.search(rf"[{v}]", w)
        r1 = m.end() if m else len(w)

    def undoubled(x: str, ends: tuple[str, ...]) -> str:
        """Without an ending that follows a double consonant, which becomes a single one."""
        end = _longest(x[r1:], ends)
        rest = x[: len(x) - len(end)]
        if not end or not (double := _longest(rest, _HU_DOUBLE)):
            return x
        return rest[: -len(double)] + double[1:]

    w = undoubled(w, ("al", "el"))
    for i, (gone, to_a, to_e) in enumerate(_HU_STEPS):
        if i == 3:
            w = undoubled(w, ("á", "é"))
            continue
        end = _longest(w[r1:], [*gone.split(), *to_a.split(), *to_e.split()])
        if end:
            w = w[: -len(end)] + ("a" if end in to_a.split() else "e" if end in to_e.split() else "")
            if i == 0 and len(w) > r1 and w[-1] in "áé":
                w = w[:-1] + {"á": "a", "é": "e"}[w[-1]]
    return w


STEMMERS: dict[str, Callable[[str], str]] = {
    "english": english, "german": german, "french": french, "spanish": spanish, "italian": italian, "portuguese": portuguese, "romanian": romanian,
    "russian": russian, "hungarian": hungarian, "swedish": swedish, "danish": danish, "norwegian": norwegian, "dutch": dutch,
}


@lru_cache(maxsize=200_000)
def stem(word: str, language: str | None) -> str:
    return STEMMERS[language](word) if language in STEMMERS else word

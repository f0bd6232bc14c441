"""Snowball stemming by the published rules: English, Portuguese, French, German and Spanish."""

from __future__ import annotations

import re
from functools import lru_cache

LANGUAGES = {"en": "english", "pt": "portuguese", "fr": "french", "de": "german", "es": "spanish"}


def name_of(language: str | None) -> str | None:
    """The full name of a supported language, given by name or code; else None."""
    language = (language or "").lower()
    language = LANGUAGES.get(language, language)
    return language if language in LANGUAGES.values() else None


def after_first(word: str, vowels: str, start: int) -> int:
    """Where the region after the first non-vowel that follows a vowel begins."""
    for k in range(start + 1, len(word)):
        if word[k] not in vowels and word[k - 1] in vowels:
            return k + 1
    return len(word)


def longest(word: str, suffixes) -> str:
    """The longest of the suffixes that the word ends in, or ''."""
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


# --- English: https://snowballstem.org/algorithms/english/stemmer.html, fixed values
EN_VOWELS = "aeiouy"
EN_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
EN_LI = "cdeghkmnrt"
EN_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
EN_SAME = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
EN_AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
EN_STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous",
    "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
EN_STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
EN_STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    word = word.replace("’", "'").replace("‘", "'").replace("‛", "'").removeprefix("'")
    if word in EN_WHOLE:
        return EN_WHOLE[word]
    if word in EN_SAME:
        return word
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    prefix = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), "")
    r1 = len(prefix) if prefix else after_first(word, EN_VOWELS, 0)
    r2 = after_first(word, EN_VOWELS, r1)
    vowel = lambda s: any(c in EN_VOWELS for c in s)
    closed = lambda s: (len(s) == 2 and s[0] in EN_VOWELS and s[1] not in EN_VOWELS) or (len(s) > 2 and s[-3] not in EN_VOWELS and s[-2] in EN_VOWELS and s[-1] not in EN_VOWELS + "wxY")
    word = word.removesuffix(longest(word, ("'s'", "'s", "'")))
    # plurals
    end = longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        word = word[:-2]
    elif end in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif end == "s" and vowel(word[:-2]):
        word = word[:-1]
    if word in EN_AFTER_1A:
        return word
    # participles
    end = longest(word, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and vowel(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(EN_DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and closed(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in EN_VOWELS:
        word = word[:-1] + "i"
    # derivations
    end = longest(word, EN_STEP_2)
    if end and len(word) - len(end) >= r1:
        stem = word[: -len(end)]
        if not (end == "ogi" and not stem.endswith("l")) and not (end == "li" and (not stem or stem[-1] not in EN_LI)):
            word = stem + EN_STEP_2[end]
    end = longest(word, EN_STEP_3)
    if end and len(word) - len(end) >= r1 and (end != "ative" or len(word) - len(end) >= r2):
        word = word[: -len(end)] + EN_STEP_3[end]
    end = longest(word, EN_STEP_4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not closed(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


# --- Portuguese: https://snowballstem.org/algorithms/portuguese/stemmer.html, fixed values
ROMANCE_VOWELS = "aeiouáéíóúâêô"
PT_STANDARD = (
    (("eza", "ezas", "ico", "ica", "icos", "icas", "ismo", "ismos", "ável", "ível", "ista", "istas", "oso", "osa", "osos", "osas", "amento", "amentos", "imento", "imentos", "adora", "ador", "aça~o", "adoras", "adores", "aço~es", "ante", "antes", "ância"), ""),
    (("logia", "logias"), "log"),
    (("ução", "uções", "uça~o", "uço~es"), "u"),
    (("ência", "ências"), "ente"),
)
PT_VERBS = (
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo "
    "ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis "
    "areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras"
).split()


def romance_rv(word: str, vowels: str) -> int:
    if len(word) > 3:
        if word[1] not in vowels:
            return next((k + 1 for k in range(2, len(word)) if word[k] in vowels), len(word))
        if word[0] in vowels:
            return next((k + 1 for k in range(2, len(word)) if word[k] not in vowels), len(word))
        return 3
    return len(word)


def portuguese(word: str) -> str:
    word = word.replace("ã", "a~").replace("õ", "o~")
    rv = romance_rv(word, ROMANCE_VOWELS)
    r1 = after_first(word, ROMANCE_VOWELS, 0)
    r2 = after_first(word, ROMANCE_VOWELS, r1)
    start = word

    def cut(suffixes, new="", region=r2) -> bool:
        nonlocal word
        end = longest(word, suffixes)
        if end and len(word) - len(end) >= region:
            word = word[: -len(end)] + new
            return True
        return False

    ends = {s: new for group, new in PT_STANDARD for s in group}
    special = ("amente", "mente", "idade", "idades", "iva", "ivo", "ivas", "ivos", "ira", "iras")
    end = longest(word, [*ends, *special])
    if end in ends:
        cut((end,), ends[end])
    elif end == "amente":
        if cut(("amente",), region=r1):
            cut(("iv",)) and cut(("at",))
            word == start[:-6] and cut(("os", "ic", "ad"))
    elif end == "mente":
        cut(("mente",)) and cut(("ante", "avel", "ível"))
    elif end in ("idade", "idades"):
        cut((end,)) and cut(("abil", "ic", "iv"))
    elif end in ("iva", "ivo", "ivas", "ivos"):
        cut((end,)) and cut(("at",))
    elif end and len(word) - len(end) >= rv and word[: -len(end)].endswith("e"):
        word = word[: -len(end)] + "ir"
    changed = word != start
    if not changed:
        changed = cut([v for v in PT_VERBS if len(word) - len(v) >= rv], region=rv)
    if changed:
        if word.endswith("ci") and len(word) - 1 >= rv:
            word = word[:-1]
    else:
        cut(("os", "a", "i", "o", "á", "í", "ó"), region=rv)
    if word.endswith(("e", "é", "ê")):
        if len(word) - 1 >= rv:
            word = word[:-1]
            if word.endswith(("gu", "ci")) and len(word) - 1 >= rv:
                word = word[:-1]
    elif word.endswith("ç"):
        word = word[:-1] + "c"
    return word.replace("a~", "ã").replace("o~", "õ")


class Cut:
    """A word that endings are taken off of, where they lie in a region."""

    def __init__(self, text: str):
        self.text = text

    def ending(self, suffixes, limit: int = 0) -> str:
        """The longest of the suffixes that begins at limit or later, or ''."""
        return longest(self.text, [e for e in suffixes if len(self.text) - len(e) >= limit])

    def off(self, suffixes, region: int, new: str = "") -> bool:
        """Puts new in place of the longest of the suffixes, if that lies in the region."""
        end = self.ending(suffixes)
        if not end or len(self.text) - len(end) < region:
            return False
        self.text = self.text[: -len(end)] + new
        return True


# --- German: https://snowballstem.org/algorithms/german/stemmer.html, fixed values
DE_VOWELS = "aeiouyäöü"
DE_S, DE_ST = "bdfghklmnrt", "bdfghklmnt"


def german(word: str) -> str:
    word = word.replace("ß", "ss")
    word = re.sub(f"(?<=[{DE_VOWELS}])[uy](?=[{DE_VOWELS}])", lambda m: m[0].upper(), word)
    r1 = after_first(word, DE_VOWELS, 0)
    r2 = after_first(word, DE_VOWELS, r1)
    r1 = max(r1, 3)
    w = Cut(word)
    before = lambda end: w.text[: -len(end)]
    # cases and plurals
    end = w.ending(("em", "ern", "er", "e", "en", "es", "s"))
    if end == "s":
        before(end)[-1:] and before(end)[-1] in DE_S and w.off(("s",), r1)
    elif end and w.off((end,), r1) and end in ("e", "en", "es") and w.text.endswith("niss"):
        w.text = w.text[:-1]
    # comparison and persons
    end = w.ending(("en", "er", "est", "st"))
    if end == "st":
        len(before(end)) > 3 and before(end)[-1] in DE_ST and w.off(("st",), r1)
    elif end:
        w.off((end,), r1)
    # derivations
    end = w.ending(("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if end in ("end", "ung"):
        if w.off((end,), r2) and not w.text.endswith("eig"):
            w.off(("ig",), r2)
    elif end in ("ig", "ik", "isch"):
        before(end).endswith("e") or w.off((end,), r2)
    elif end in ("lich", "heit"):
        w.off((end,), r2) and w.off(("er", "en"), r1)
    elif end:
        w.off((end,), r2) and w.off(("lich", "ig"), r2)
    return w.text.lower().translate(str.maketrans("äöü", "aou"))


# --- Spanish: https://snowballstem.org/algorithms/spanish/stemmer.html, fixed values
ES_VOWELS = "aeiouáéíóúü"
ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
ES_ACCENTED, ES_PLAIN = "iéndo ándo ár ér ír".split(), "ando iendo ar er ir".split()
ES_STANDARD = (
    ("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos", ""),
    ("logía logías", "log"),
    ("ución uciones", "u"),
    ("encia encias", "ente"),
)
ES_AFTER = (
    ("adora ador ación adoras adores aciones ante antes ancia ancias", "ic"),
    ("mente", "ante able ible"),
    ("idad idades", "abil ic iv"),
    ("iva ivo ivas ivos", "at"),
)
ES_Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
ES_U_VERBS = "en es éis emos".split()
ES_VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera "
    "ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados "
    "idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
ACUTE = str.maketrans("áéíóú", "aeiou")


def spanish(word: str) -> str:
    rv = romance_rv(word, ES_VOWELS)
    r1 = after_first(word, ES_VOWELS, 0)
    r2 = after_first(word, ES_VOWELS, r1)
    w = Cut(word)
    # attached pronouns
    pronoun = w.ending(ES_PRONOUNS)
    if pronoun:
        verb = Cut(word[: -len(pronoun)])
        form = verb.ending([*ES_ACCENTED, *ES_PLAIN, "yendo"], rv)
        if form in ES_ACCENTED:
            w.text = verb.text[: -len(form)] + form.translate(ACUTE)
        elif form and (form != "yendo" or verb.text.endswith("uyendo")):
            w.text = verb.text
    # standard endings
    plain = {end: new for ends, new in ES_STANDARD for end in ends.split()}
    after = {end: more.split() for ends, more in ES_AFTER for end in ends.split()}
    end = w.ending([*plain, *after, "amente"])
    if end == "amente":
        done = w.off((end,), r1)
        if done:
            if w.text.endswith("iv"):
                w.off(("iv",), r2) and w.off(("at",), r2)
            else:
                w.off(("os", "ic", "ad"), r2)
    elif end in plain:
        done = w.off((end,), r2, plain[end])
    else:
        done = bool(end) and w.off((end,), r2)
        done and w.off(after[end], r2)
    # verbs
    if not done:
        end = w.ending(ES_Y_VERBS, rv)
        if end and w.text[: -len(end)].endswith("u"):
            w.text = w.text[: -len(end)]
        else:
            end = w.ending([*ES_U_VERBS, *ES_VERBS], rv)
            if end:
                w.text = w.text[: -len(end)]
                if end in ES_U_VERBS and w.text.endswith("gu"):
                    w.text = w.text[:-1]
    # what is left
    end = w.ending(("os", "a", "o", "á", "í", "ó", "e", "é"))
    if end and w.off((end,), rv) and end in ("e", "é") and w.text.endswith("gu"):
        w.off(("u",), rv)
    return w.text.translate(ACUTE)


# --- French: https://snowballstem.org/algorithms/french/stemmer.html, fixed values; capitals are vowels that count as consonants
FR_VOWELS = "aeiouyâàëéêèïîôûù"
FR_R2 = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
FR_IC = "atrice ateur ation atrices ateurs ations".split()
FR_NEW = {"logie": "log", "logies": "log", "usion": "u", "ution": "u", "usions": "u", "utions": "u", "ence": "ent", "ences": "ent"}
FR_I_VERBS = (
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it"
).split()
FR_E_VERBS = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
FR_A_VERBS = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def french_marked(word: str) -> str:
    """u and i between vowels, y beside one and u after q as capitals."""
    out = list(word)
    for k, c in enumerate(out):
        left, right = k > 0 and out[k - 1] in FR_VOWELS, k + 1 < len(out) and out[k + 1] in FR_VOWELS
        if (c in "ui" and left and right) or (c == "y" and (left or right)) or (c == "u" and k > 0 and out[k - 1] == "q"):
            out[k] = c.upper()
    return "".join(out)


def french_rv(word: str) -> int:
    if word.startswith(("par", "col", "tap")) or (len(word) > 2 and word[0] in FR_VOWELS and word[1] in FR_VOWELS):
        return 3
    return next((k + 1 for k in range(1, len(word)) if word[k] in FR_VOWELS), len(word))


def french_standard(w: Cut, rv: int, r1: int, r2: int) -> bool:
    """Whether a standard ending was taken off that no verb ending can precede."""
    end = w.ending([*FR_R2, *FR_IC, *FR_NEW, *"ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments".split()])
    if not end:
        return False
    before = w.text[: -len(end)]
    if end in FR_R2:
        return w.off((end,), r2)
    if end in FR_NEW:
        return w.off((end,), r2, FR_NEW[end])
    if end in FR_IC:
        return w.off((end,), r2) and (w.off(("ic",), r2) or w.off(("ic",), 0, "iqU") or True)
    if end in ("ement", "ements"):
        if not w.off((end,), rv):
            return False
        more = w.ending(("iv", "eus", "abl", "iqU", "ièr", "Ièr"))
        if more == "iv":
            w.off((more,), r2) and w.off(("at",), r2)
        elif more == "eus":
            w.off((more,), r2) or w.off((more,), r1, "eux")
        elif more in ("abl", "iqU"):
            w.off((more,), r2)
        elif more:
            w.off((more,), rv, "i")
        return True
    if end in ("ité", "ités"):
        if not w.off((end,), r2):
            return False
        more = w.ending(("abil", "ic", "iv"))
        if more:
            w.off((more,), r2) or (more != "iv" and w.off((more,), 0, "abl" if more == "abil" else "iqU"))
        return True
    if end in ("if", "ive", "ifs", "ives"):
        if not w.off((end,), r2):
            return False
        if w.off(("at",), r2):
            w.off(("ic",), r2) or w.off(("ic",), 0, "iqU")
        return True
    if end == "eaux":
        return w.off((end,), 0, "eau")
    if end == "aux":
        return w.off((end,), r1, "al")
    if end in ("euse", "euses"):
        return w.off((end,), r2) or w.off((end,), r1, "eux")
    if end in ("issement", "issements"):
        return bool(before) and before[-1] not in FR_VOWELS and w.off((end,), r1)
    if end in ("amment", "emment"):
        w.off((end,), rv, end[0] + "nt")
    elif before and before[-1] in FR_VOWELS and len(before) - 1 >= rv:
        w.off((end,), 0)
    return False


def french_verb(w: Cut, rv: int, r2: int) -> bool:
    """Whether the ending of a verb was taken off."""
    end = w.ending(FR_I_VERBS, rv)
    at = len(w.text) - len(end)
    if end and at - 1 >= rv and w.text[at - 1] not in FR_VOWELS:
        return w.off((end,), rv)
    end = w.ending(["ions", *FR_E_VERBS, *FR_A_VERBS], rv)
    if not end or not w.off((end,), r2 if end == "ions" else rv):
        return False
    end in FR_A_VERBS and w.off(("e",), rv)
    return True


def french(word: str) -> str:
    word = french_marked(word)
    rv = french_rv(word)
    r1 = after_first(word, FR_VOWELS, 0)
    r2 = after_first(word, FR_VOWELS, r1)
    w = Cut(word)
    if french_standard(w, rv, r1, r2) or french_verb(w, rv, r2):
        w.off(("Y",), 0, "i") or w.off(("ç",), 0, "c")
    else:
        if len(w.text) > 1 and w.text.endswith("s") and w.text[-2] not in "aiouès":
            w.text = w.text[:-1]
        end = w.ending(("ion", "ier", "ière", "Ier", "Ière", "e", "ë"), rv)
        if end == "ion":
            at = len(w.text) - 3
            at - 1 >= rv and w.text[at - 1] in "st" and w.off((end,), r2)
        elif end == "e":
            w.off((end,), rv)
        elif end == "ë":
            len(w.text) - 3 >= rv and w.text.endswith("guë") and w.off((end,), rv)
        elif end:
            w.off((end,), rv, "i")
    if w.text.endswith(("enn", "onn", "ett", "ell", "eill")):
        w.text = w.text[:-1]
    return re.sub(f"[éè](?=[^{FR_VOWELS}]+$)", "e", w.text).lower()


STEMMERS = {"english": english, "portuguese": portuguese, "french": french, "german": german, "spanish": spanish}


@lru_cache(maxsize=200_000)
def stem(word: str, language: str) -> str:
    return STEMMERS[language](word.lower())

"""Terms of pages: tokens, filters, languages and sound codes."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words.
ENGLISH = """'d 'll 'm 's 've about above after again against all am an and any are aren't as at be because been before being
below between both but by can can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from
further get had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's
i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no none nor not of off on once
only or other ought our ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that that's
the their theirs them themselves then there there's these they they'd they'll they're they've this those through to too under
until up very want was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's
whom why why's with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves"""
#: German stop words.
GERMAN = """ab aber alle allem allen alles als also am an andere anderem anderer anderes anders ans auch auf aufs aus ausser ausserdem bei
beide beiden beides beim bereits bestehen besteht bevor bin bis bloss brauchen braucht bzw da dabei dadurch dafür dagegen
daher damit danach dann dar daran darauf darf darum darunter darüber das dass davon dazu dein dem demnach den denen denn
dennoch der deren des deshalb dessen dich die dies diese dieselbte diesem diesen dieser dieses diesmal dir doch dort du durch
durfte durften dürfen ebenfalls ebenso eigene eigenem eigenen eigener eigenes ein eine einem einen einer eines einige einiges
einmal einzelne einzelnen einzig entweder er erst erste ersten es etwa etwas euch falls fast ferner folgender folglich für
ganz ganze gar geben gegen gehabt gekonnt gemäss getan gewesen gewollt geworden gibt hab habe haben hallo hat hatte hatten
heraus herein hier hin hinaus hinein hinter hinzu hätte hätten ich ihm ihn ihnen ihr ihre ihrem ihren ihrer ihres im immer in
indem infolge innen innerhalb ins inzwischen irgend irgendwas irgendwen irgendwer irgendwie irgendwo ist jede jedem jeden
jeder jederzeit jedes jedoch jene jenem jenen jener jenes jeweiligen jeweils kann kein keine keinem keinen keiner keines
kommen kommt konnte konnten können könnte könnten lassen leer machen macht machte machten man mehr mein meine meinem meinen
meiner meist meiste meisten mich mit muss musste mussten möchte möchten müssen müssten nach nachdem nacher neben nein nicht
nichts noch nun nur nämlich ob obgleich obwohl oder ohne schon sehr seid sein seine seinem seinen seiner seines seit seitdem
seither selber selbst sich sie siehe sind so sobald sofern sofort sogar solange solch solche solchem solchen solcher solches
soll sollen sollte sollten somit sondern sonst sonstiges soweit sowie sowohl statt stets such u.v.m. um ums und uns unser
unsere unserem unseren unserer unter viel viele vielen vieler vom von vor vorbei vorher vorüber wann war waren warum was weg
wegen weil weit weiter weitere weiterem weiteren weiterer weiteres weiterhin welche welchem welchen welcher welches wem wen
wenigstens wenn wenngleich wer werde werden weshalb wessen wie wieder will wir wird wo wodurch wohin wollen wollte wollten
worin wurde wurden während wäre wären würde würden z.b zeigen zeigt zu zudem zufolge zum zur zurück zusammen zwar zwischen
zzgl über"""
#: Characters that no term may have.
BAD_CHARACTERS = "#$%()*,0123456789:;<>@[]{|}§"
SHORTEST, LONGEST = 2, 80
#: Ends of addresses by the language they stand for.
DOMAIN_LANGUAGES = {
    "english": ".com .org .uk .au .us .gov .mil",
    "german": ".de .at",
    "danish": ".dk",
    "dutch": ".nl",
    "finnish": ".fi",
    "french": ".fr",
    "hungarian": ".hu",
    "italian": ".it",
    "norwegian": ".no",
    "portuguese": ".pt .br",
    "romanian": ".ro",
    "russian": ".ru",
    "spanish": ".es .mx",
    "swedish": ".se",
    "turkish": ".tr",
}
_CONTRACTIONS = ("'m", "'s", "'d", "'ve", "'ll")
_ADDRESSES = ("http://", "ftp://", "mailto:")


def stop_words() -> list[str]:
    return sorted({*ENGLISH.split(), *GERMAN.split()})


_STOP = frozenset(stop_words())


def _punctuation(c: str) -> bool:
    return unicodedata.category(c)[0] == "P"


def tokens(text: str) -> list[str]:
    """Words between white space; addresses whole, else punctuation at their ends and contractions are tokens of their own."""
    out: list[str] = []
    for word in text.split():
        if word.startswith(_ADDRESSES):
            out.append(word)
            continue
        end = len(word)
        while end and _punctuation(word[end - 1]):
            end -= 1
        begin = 0
        while begin < end and _punctuation(word[begin]):
            begin += 1
        for part in (word[:begin], word[begin:end], word[end:]):
            if not part:
                continue
            cut = next((len(c) for c in _CONTRACTIONS if part.endswith(c) and len(part) > len(c)), 0)
            head, tail = (part[:-cut], part[-cut:]) if cut else (part, "")
            if head.endswith("n't"):
                out += [x for x in (head[:-3], "n't") if x]
            else:
                out.append(head)
            if tail:
                out.append(tail)
    return out


def is_term(word: str) -> bool:
    return SHORTEST <= len(word) <= LONGEST and any(map(str.isalpha, word)) and word not in _STOP and not set(word) & set(BAD_CHARACTERS)


def terms(text: str) -> list[str]:
    return [t for t in map(str.lower, tokens(text)) if is_term(t)]


def is_term_column(word: Column) -> Column:
    """The same filter as a column, for words that are split already."""
    bad = "[" + "".join("\\" + c if c in "[]" else c for c in BAD_CHARACTERS) + "]"
    return F.length(word).between(SHORTEST, LONGEST) & word.rlike(r"\p{L}") & ~word.isin(stop_words()) & ~word.rlike(bad)


def soundex_code(term: Column) -> Column:
    """The sound code of a term from its first letter on, or null if that makes none."""
    code = F.soundex(F.regexp_replace(term, "^[^A-Za-z]+", ""))
    return F.when(code.rlike("^[A-Z][0-9]{3}$"), code)


def _by_end(address: Column) -> Column:
    found = F.lit(None).cast("string")
    for language, ends in DOMAIN_LANGUAGES.items():
        found = F.when(reduce(lambda a, b: a | b, (address.endswith(e) for e in ends.split())), F.lit(language)).otherwise(found)
    return found


def language(lang: Column, domain: Column) -> Column:
    """The stemming language of a page: by its lang attribute if it has one, even one that is not known, else by its domain."""
    prefix = F.regexp_extract(lang, "^([^-]*)", 1)
    named = F.when(prefix == "en", F.lit("english")).otherwise(_by_end(F.concat(F.lit("."), prefix)))
    return F.when(lang.isNotNull(), named).otherwise(_by_end(domain))


def url_domain(url: Column) -> Column:
    """scheme://host[:port] of an address."""
    return F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def is_absolute_http(url: Column) -> Column:
    return url.rlike("^https?://[^/?#]")


def without_last_slash(url: Column) -> Column:
    """The key by which an address and the same with a slash count as one."""
    return F.regexp_replace(url, "/$", "")


def joined_url(base: Column, rest: Column) -> Column:
    """Two parts of an address with one slash between them."""
    return F.concat(F.regexp_replace(base, "/$", ""), F.lit("/"), F.regexp_replace(rest, "^/", ""))

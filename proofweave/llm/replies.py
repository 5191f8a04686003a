"""Defective question and reply pairs.

A pair gets at most one defect, the first that holds of: ``empty``, ``copied``, ``refusal``, ``truncated``,
``language``.

* ``empty``: null, blank, nothing but marks, or a word for "nothing".
* ``copied``: greedy string tiling covers the question with tiles of the reply, and outside the tiles the
  reply holds at most a short introduction before the first tile.
* ``refusal``: a refusal grammar matches a sentence of the reply outside quotations, and nothing outside such
  sentences answers the question.
* ``truncated``: a pushdown parser over fences, code, brackets, quotations, emphasis, tags, tables, lists and
  sentences ends inside a construct. A closer only closes the construct on top of the stack.
* ``language``: script and function-word checks find the reply outside quotations in another language
  than the question.

Defined results: a null question has no language and cannot be copied; a null reply is empty; repeated rows
give one result; replies of any length are parsed whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that stand for an empty reply, without marks and in lower case.
NOTHING = frozenset(
    "na|n a|none|null|nil|nan|nothing|no answer|no reply|no response|no data|no content|no comment available|not available|not applicable|undefined|empty|blank|void|unknown"
    "|nichts|keine|keine antwort|keine angabe|leer|rien|aucune|aucune réponse|aucune reponse|pas de réponse|sans réponse|néant|vide|nada|ninguna|ninguno|sin respuesta|sin datos|vacío"
    "|niente|nulla|nessuna risposta|nessuno|vuoto".split("|")
)

# Frequent function words of the languages told apart.
FUNCTION_WORDS = {
    "en": "the of and to in that was is by for on with which as at from not it be had has have were been who what when how did does about say are any there why would an this or his her their no under after before because",
    "fr": "le la les de des du un une et est que qui dans pour par sur avec pas ne au aux ce cette son sa ses en il elle quel quelle quelles quels dit était sont avant après sans jamais fois malgré lors comme avait devait peut nous vous l d n qu s c",
    "de": "der die das den dem des ein eine einen einem einer und ist war wer wie was welche welcher nicht mit für von zu im am auf bei nach vor aus über durch ohne wegen hat hatte wurde sich als auch trotz sagt zum zur während in an so",
    "es": "el la los las de del un una y es que en por para con no se al su sus lo como quién qué cuándo era fue había debía antes después sin tras durante dice sobre más nunca pero esta este",
    "it": "il lo la i gli le di del della dei delle dello un una e è che in per con non si al alla ai nel nella sul su come chi cosa era aveva doveva prima dopo senza mai durante quali ha da dal sono più questa questo l d dell all nell",
    "nl": "de het een en van in is dat niet op te met voor zijn er aan door ook als bij naar uit maar dan was werd heeft had hebben worden deze dit die om over tot nog wel geen wat wie waar tegen onder tussen zonder tijdens volgens omdat",
    "pt": "o a os as um uma e é de do da dos das em no na nos nas que não com por para se mais como mas foi ele ela ao à pelo pela são já também até isso antes depois sem durante porque foram estava seu sua",
    "pl": "i w z na do nie się jest że o to od za po jak przez dla był była było były są nad pod bez przed ale lub oraz który która które tego tym jego jej ich już przy tylko ten ta",
    "sv": "och att det i en ett som är av för på med inte den de till var har han hon om men från vid när efter före utan eller hade blev under mot mellan också",
    "da": "og at det i en et som er af for på med ikke den de til var har han hun om men fra ved når efter før uden eller havde blev under mod mellem også",
    "cs": "a v z na do se je že o to od za po jak pro byl byla bylo byly jsou nad pod bez před ale nebo který která které toho tím jeho její jejich už při jen ten ta není",
    "ro": "și în de la cu pe pentru că nu este a fost din mai sau dar care ce sunt prin după înainte fără acest această lui ei un o al ale",
    "hu": "a az és hogy nem is volt egy van meg csak de mint már vagy ki mi el azt ez ezt amely után előtt nélkül során miatt",
    "fi": "ja on ei se että oli hän mutta tai kun jos niin kuin myös ovat joka mikä sen siitä ennen jälkeen ilman aikana vuoksi",
    "tr": "ve bir bu da de için ile olarak daha çok ama gibi kadar sonra önce değil var yok olan olduğu tarafından ancak veya",
}
_BAGS = {name: frozenset(words.split()) for name, words in FUNCTION_WORDS.items()}
_EVERY_WORD = frozenset().union(*_BAGS.values())
#: The first five are told apart by all their words, the others only by words that none of the five has.
_FIRST = ("en", "fr", "de", "es", "it")
_LANGUAGES = {name: bag if name in _FIRST else bag.difference(*(_BAGS[f] for f in _FIRST)) for name, bag in _BAGS.items()}

# Endings after which a text goes on.
OPEN_ENDS = frozenset(
    "the a an of to in on at for and or but that which who with by from as because although though if when while than whose where is was were are be been had has have not no so"
    " le la les un une des du de et ou que qui dans pour par sur avec der die das den dem ein eine und oder dass mit für von zu el los las una del y o por con il lo gli di della e per cf see siehe vgl voir véase vedi".split()
)

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|‹[^›\n]*›|`[^`\n]*`")
_TERMINAL = re.compile(r"[.!?…。！？؟][\"'”’»)\]*_`]*$")
_CITED = re.compile(r"\[[^\[\]\n]+\][\"'”’»)*_`]*$")
_LIST_ITEM = re.compile(r"^\s*(?:[-*+•–]|\d{1,3}[.)]|[a-z]\))\s+\S")
_DANGLING = re.compile(r"^\s*(?:[-*+•–]|\d{1,3}[.)]|[a-z]\)|#{1,6}|>)\s*$")
# Brackets and quotations, opener and closers.
_OPENERS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "‹": "›", "„": "“”"}
# Names of tags, those without content, and those whose end may be left out.
_TAGS = frozenset("a b i u s em strong code pre p div span ul ol li table thead tbody tr td th blockquote sup sub h1 h2 h3 h4 h5 h6 details summary dl dt dd br hr img input small mark del ins".split())
_VOID = frozenset("br hr img input".split())
_OPTIONAL = frozenset("p li td th tr dt dd thead tbody".split())
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)\b[^<>]*?(/?)>")


def words(text: str) -> list[str]:
    """Words of a text in lower case."""
    return [w.lower().replace("’", "'") for w in _WORD.findall(text)]


def is_empty(reply: str | None) -> bool:
    """Null, blank, only marks, or a word for nothing."""
    if reply is None:
        return True
    bare = " ".join(re.findall(r"[^\W_]+", reply.lower()))
    return not bare or bare in NOTHING


def tiles(pattern: list[str], text: list[str], shortest: int) -> tuple[list[bool], list[bool]]:
    """Greedy string tiling: marks of ``pattern`` and ``text``, longest common stretches first. A stretch of
    the pattern may be laid on the text again, as a reply can repeat the question."""
    used = [False] * len(text)
    covered = [False] * len(pattern)
    places: dict[str, list[int]] = {}
    for i, w in enumerate(pattern):
        places.setdefault(w, []).append(i)
    while True:  # a round for every length of tile
        best, found = shortest - 1, []
        for j, w in enumerate(text):
            if used[j]:
                continue
            for i in places.get(w, ()):
                k = 0
                while i + k < len(pattern) and j + k < len(text) and not used[j + k] and pattern[i + k] == text[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k >= shortest:
                    found.append((i, j))
        if not found:
            return covered, used
        for i, j in found:
            if not any(used[j : j + best]):
                used[j : j + best] = [True] * best
                covered[i : i + best] = [True] * best


def is_copied(question: str | None, reply: str) -> bool:
    """Whether the reply gives back the question and no more."""
    if not question:
        return False
    q, r = words(question), words(reply)
    known = set(q)
    if not q or len(r) < 0.8 * len(q) or sum(w in known for w in r) < 0.6 * len(r) - 6:
        return False
    covered, used = tiles(q, r, min(3, len(q)))
    if sum(covered) < 0.85 * len(q) or not any(used):
        return False
    first, last = used.index(True), len(used) - 1 - used[::-1].index(True)
    inside, copies = sum(not u for u in used[first : last + 1]), max(round(sum(used) / len(q)), 1)
    return first <= 6 and last == len(used) - 1 and inside <= 0.15 * len(q) * copies + 4 * (copies - 1)


def outside_quotes(text: str) -> str:
    """The text without quotations and code."""
    return _QUOTED.sub(" ", text)


# The refusal grammar, one alternative per construction.
_REFUSALS = {
    "en": r"""
        \b(?:i|we)(?:'m|\s+am|\s+are|'re)?\s+(?:\w+\s+){0,2}?(?:can't|cannot|can\s+not|could\s+not|couldn't|won't|will\s+not|would\s+rather\s+not|am\s+unable|are\s+unable|unable|not\s+able|not\s+permitted|not\s+allowed|not\s+authori[sz]ed|not\s+in\s+a\s+position|not\s+comfortable|do\s+not\s+feel\s+comfortable|don't\s+feel\s+comfortable|must\s+decline|have\s+to\s+decline|respectfully\s+decline|decline|must\s+refuse|refuse|prefer\s+not|regret\s+that)\b
        | \bnot\s+in\s+a\s+position\s+to\b | \b(?:is|be)\s+not\s+something\s+(?:i|we)\s+can\b | ^\W*(?:sorry|apologies|regrettably|unfortunately)\b[^.]*\b(?:can't|cannot|can\s+not|not\s+able|unable|no\s+answer|not\s+possible|won't|not)\b
        | ^\W*(?:can't|cannot|won't|unable\s+to)\b | \bno\s+(?:answer|reply|response|comment|opinion|advice)\s+can\s+be\s+(?:given|provided|offered)\b
        | \boutside\s+(?:what|of\s+what|the\s+scope)\b[^.]*\b(?:i|my|permitted|allowed)\b | \b(?:falls|lies|is)\s+(?:outside|beyond)\s+(?:my|what\s+i)\b
        | \bmy\s+(?:guidelines|instructions|rules|policy|policies|programming|usage\s+rules|terms)\s+(?:\w+\s+){0,2}?(?:prevent|forbid|prohibit|don't|do\s+not|bar|stop|keep)\b
        | \b(?:breach|violate|contravene|against|contrary\s+to)\s+my\s+(?:\w+\s+){0,2}?(?:rules|guidelines|policy|policies|terms|instructions)\b | \bas\s+an?\s+(?:ai|language|artificial|automated|virtual|digital)\b[^.]*\b(?:not|cannot|can't|unable|n't)\b""",
    "fr": r"""
        \bje\s+(?:ne\s+(?:peux|puis|suis|saurais|souhaite|veux|dois)\b[^.]{0,40}?(?:\bpas\b|\brépondre|\baider|\bdonner|\bme\s+prononcer)|regrette\b|refuse\b|dois\s+(?:refuser|décliner)|préfère\s+ne\s+pas|suis\s+(?:désolé|navré|dans\s+l'impossibilité))
        | \bil\s+(?:ne\s+)?m'est\s+(?:pas\s+)?(?:impossible|possible|permis|interdit) | ^\W*(?:désolée?|navrée?|je\s+m'excuse)\b | \b(?:aucune\s+réponse|cette\s+demande|cette\s+question)\b[^.]{0,40}\b(?:ne\s+peut|dépasse|sort)\b | \bmes\s+(?:consignes|règles|instructions)\b""",
    "de": r"""
        \b(?:tut\s+mir\s+leid|bedaure|bedauere)\b | \b(?:kann|darf|möchte|werde)\s+ich\b[^.]{0,60}\b(?:nicht|keine?n?r?)\b | \bich\s+(?:kann|darf|möchte|werde|bin|sehe)\b[^.]{0,60}\b(?:nicht|keine?n?r?|außerstande)\b | \bich\s+(?:muss|lehne)\b[^.]{0,60}\bab(?:lehnen)?\b
        | \b(?:ist|war)\s+(?:es\s+)?mir\s+(?:leider\s+)?(?:nicht|unmöglich) | \bleider\b[^.]{0,60}\b(?:nicht|keine?n?r?)\b | \bmeine\s+(?:richtlinien|vorgaben|regeln)\b | \b(?:diese|die)\s+(?:frage|anfrage)\b[^.]{0,40}\b(?:nicht\s+beantwort|außerhalb|überschreitet)""",
    "es": r"""
        \b(?:lo\s+siento|lamento|lamentablemente)\b | ^\W*no\s+(?:puedo|podemos|me\s+es\s+posible|me\s+está\s+permitido|estoy|se\s+puede|puede)\b | \b(?:yo\s+)?no\s+(?:puedo|podemos)\s+(?:\w+\s+){0,2}?(?:ayudar|responder|contestar|opinar|dar|ofrecer|comentar|hablar|atender|facilitar)\w*
        | \bno\s+me\s+(?:es|está|resulta)\s+(?:posible|permitido) | \bno\s+estoy\s+(?:autorizad|en\s+condiciones|en\s+posición|capacitad|facultad) | \b(?:debo|tengo\s+que)\s+(?:declinar|rechazar|negarme) | \bmis\s+(?:normas|directrices|reglas|instrucciones)\b""",
    "it": r"""
        \b(?:mi\s+dispiace|mi\s+rincresce|spiacente|sono\s+spiacente|purtroppo)\b | \bnon\s+(?:posso|possiamo)\b | \bnon\s+mi\s+è\s+(?:possibile|consentito|permesso) | \bnon\s+sono\s+(?:autorizzat|in\s+grado|nella\s+posizione|abilitat) | \b(?:devo|debbo)\s+(?:rifiutare|declinare) | \ble\s+mie\s+(?:regole|linee|istruzioni)\b""",
    "nl": r"""\b(?:het\s+)?spijt\s+me\b | \bik\s+(?:kan|mag|wil|zal)\b[^.]{0,60}\b(?:niet|geen)\b | \b(?:kan|mag)\s+ik\b[^.]{0,60}\b(?:niet|geen)\b | \bhelaas\b[^.]{0,60}\b(?:niet|geen)\b""",
    "pt": r"""\blamento\b | \binfelizmente\b[^.]*\bnão\b | ^\W*(?:desculpe|sinto\s+muito)\b | \bnão\s+(?:posso|podemos|me\s+é\s+(?:possível|permitido)|estou\s+(?:autorizad|em\s+condições))""",
    "pl": r"""\bprzykro\s+mi\b | \bprzepraszam\b | \bniestety\b[^.]*\bnie\b | \bnie\s+(?:mogę|możemy|wolno\s+mi|jestem\s+w\s+stanie)\b""",
    "sv": r"""\b(?:tyvärr|beklagar|ledsen)\b[^.]*\b(?:inte|ingen|inga)\b | \bjag\s+(?:kan|får|vill)\s+(?:tyvärr\s+)?inte\b""",
}


@lru_cache(maxsize=1)
def _refusal_patterns() -> dict:
    return {name: re.compile(p, re.I | re.X) for name, p in _REFUSALS.items()}


# Words by which a sentence speaks to the asker or of the one who answers.
_ADDRESS = frozenset("i i'm i'll me my we our you your please je j me moi mes mon ma vous votre vos ich mir mich mein meine sie ihre ihnen yo me mi mis usted su io mi mio mie miei lei ik mijn u uw eu meu minha jag min ja mnie moje".split())


def _answers(sentence: str, asked: set[str]) -> bool:
    """Whether a sentence tells something on the matter: a reference, or words of the question that it does not
    merely address to the asker."""
    if re.search(r"\[[A-Z]{1,3}\d+\]", sentence):
        return True
    found = set(words(sentence))
    return not found & _ADDRESS and bool(found & asked)


def is_refusal(reply: str, question: str | None = None) -> bool:
    """Whether the reply, outside quotations, declines to answer: some sentence refuses and, outside the sentences
    that do, nothing answers the question."""
    plain = outside_quotes(reply).replace("’", "'").strip()
    sentences = [x for x in re.split(r"(?<=[.!?])\s+|\n+", plain) if words(x)]
    refusing = [any(p.search(x) for p in _refusal_patterns().values()) for x in sentences]
    if not any(refusing) or re.search(r"\[[A-Z]{1,3}\d+\]", plain):
        return False
    asked = {w for w in words(question or "") if len(w) > 3 and w not in _EVERY_WORD}
    told = [x for x, r in zip(sentences, refusing, strict=True) if not r and _answers(x, asked)]
    if any(refusing[:2]):
        # What opens as a refusal stays one unless most of it goes on to answer.
        return sum(len(words(x)) for x in told) <= 0.5 * len(words(plain))
    return not told


def open_constructs(text: str) -> list[str]:
    """Constructs still open at the end of a text, outermost first.

    A pushdown parser: fences, code, tags, brackets, quotations and emphasis are pushed when they open and popped
    when their closer meets them on top of the stack. A closer that does not fit the top is no closer, as list
    labels such as ``1)`` have no opener; so ``([)]`` leaves its round bracket open.
    """
    stack: list[tuple[str, str]] = []
    for line in text.split("\n"):
        bare = line.lstrip()
        if stack and stack[-1][0] == "fence":
            if bare.startswith("```"):
                stack.pop()
            continue
        if bare.startswith("```"):
            stack.append(("fence", "```"))
            continue
        _read_line(line, stack)
    return ["```" if kind == "fence" else what for kind, what in stack if not (kind == "tag" and what in _OPTIONAL)]


def _read_line(line: str, stack: list[tuple[str, str]]) -> None:
    i, n = 0, len(line)
    while i < n:
        c = line[i]
        kind, what = stack[-1] if stack else ("", "")
        if kind == "code":
            if line.startswith(what, i):
                stack.pop()
                i += len(what)
            else:
                i += 1
        elif c == "`":
            run = re.match(r"`+", line[i:]).group(0)
            stack.append(("code", run))
            i += len(run)
        elif line.startswith(("**", "__", "~~"), i) and not re.match(r"(.)\1\1", line[i:]):
            sign = line[i : i + 2]
            if (kind, what) == ("sign", sign):
                stack.pop()
            elif i + 2 < n and not line[i + 2].isspace():
                stack.append(("sign", sign))
            i += 2
        elif c == "<":
            tag = _TAG.match(line, i)
            if tag and tag.group(2).lower() in _TAGS:
                _read_tag(tag.group(2).lower(), bool(tag.group(1)), bool(tag.group(3)), stack)
                i = tag.end()
            else:
                if re.fullmatch(r"</?[A-Za-z]*", line[i:]) and line[i + 1 :].strip("/").lower() in _TAGS:
                    stack.append(("sign", "<"))
                i += 1
        else:
            if kind == "mark" and c in what:
                stack.pop()
            elif c == '"':
                stack.append(("mark", '"'))
            elif c in _OPENERS:
                stack.append(("mark", _OPENERS[c]))
            i += 1 if c not in "*_~" else len(re.match(r"[*_~]+", line[i:]).group(0))


def _read_tag(name: str, closes: bool, empty: bool, stack: list[tuple[str, str]]) -> None:
    if not closes:
        if not empty and name not in _VOID:
            stack.append(("tag", name))
        return
    depth = len(stack)
    while depth and stack[depth - 1][0] == "tag" and stack[depth - 1][1] != name and stack[depth - 1][1] in _OPTIONAL:
        depth -= 1
    if depth and stack[depth - 1] == ("tag", name):
        del stack[depth - 1 :]


def _complete_row(line: str, cells: int) -> bool:
    line = line.strip()
    inner = [c.strip() for c in line.strip("|").split("|")]
    return line.endswith("|") and len(line) > 1 and len(inner) >= cells and all(inner) and not all(set(c) <= set("-: ") for c in inner)


def is_truncated(reply: str) -> bool:
    """Whether the reply breaks off within a word, sentence, list, table or reference."""
    text = reply.rstrip()
    if open_constructs(text):
        return True
    text = _TAG.sub(lambda m: "" if m.group(2).lower() in _TAGS else m.group(0), text)
    lines = [x for x in text.split("\n") if x.strip()]
    last = lines[-1].strip() if lines else "```"
    if last.startswith("```") or re.fullmatch(r"[-*_]{3,}", last):
        return False
    if last.startswith("|"):
        table = []
        for x in reversed(lines):
            if not x.strip().startswith("|"):
                break
            table.append(x)
        return not _complete_row(last, len(table[-1].strip().strip("|").split("|")))
    if _DANGLING.match(last) or re.match(r"^#{1,6}\s", last):
        return True
    tail = re.sub(r"[\"'”’»)*_`\]]+$", "", last)
    end = words(tail)[-1] if words(tail) else ""
    if last.endswith((":", ",", ";", "(", "[", "/", "=", "-", "–", "—")) and len(words(text)) > 1:
        return True
    if _TERMINAL.search(last):
        sentence = re.split(r"(?<=[.!?])\s+", last)[-1]
        return bool(re.fullmatch(r"(?:cf|see|siehe|vgl|voir|véase|vedi|no|nr|art|para)\.", sentence.strip().lower()))
    if _CITED.search(last):
        return False
    if end in OPEN_ENDS:
        return True
    if _LIST_ITEM.match(last):
        others = [x.strip() for x in lines[:-1] if _LIST_ITEM.match(x)]
        return any(_TERMINAL.search(x) or _CITED.search(x) for x in others)
    return len(lines) > 1 or len(words(text)) > 6


def _plain_words(text: str) -> list[str]:
    """Words outside quotations, elided articles on their own."""
    return re.findall(r"[^\W_]+", outside_quotes(text).lower())


def _hits(text: str) -> dict[str, int]:
    found = [w for w in _plain_words(text) if w in _EVERY_WORD]
    return {name: sum(w in bag for w in found) for name, bag in _LANGUAGES.items()}


def language_of(text: str, least: int = 2) -> str | None:
    """The language whose function words clearly prevail; None if none does or it has fewer than ``least``."""
    ranked = sorted(_hits(text).items(), key=lambda x: -x[1])
    (best, n), (_, second) = ranked[0], ranked[1]
    return best if n >= least and n > second else None


@lru_cache(maxsize=1)
def _scripts() -> dict:
    import regex

    return {name: regex.compile(rf"\p{{{name}}}") for name in ("Latin", "Greek", "Cyrillic", "Arabic", "Hebrew", "Han", "Hiragana", "Katakana", "Hangul", "Devanagari", "Thai")}


def script_of(text: str) -> str | None:
    """The script of most letters."""
    if text.isascii():
        return "Latin" if any(c.isalpha() for c in text) else None
    counts = {name: len(p.findall(text)) for name, p in _scripts().items()}
    name = max(counts, key=counts.get)
    return name if counts[name] else None


def is_other_language(question: str | None, reply: str) -> bool:
    """Whether the reply outside quotations is wholly in another language than the question."""
    if not question:
        return False
    plain = outside_quotes(reply)
    asked, answered = script_of(question), script_of(plain)
    if asked and answered and asked != answered and len(words(plain)) >= 3:
        return True
    want, got = language_of(question), language_of(plain, 3)
    if not want or not got or want == got:
        return False
    found = _plain_words(plain)
    wanted, used = _BAGS[want], _BAGS[got]
    return sum(w in wanted and w not in used for w in found) <= 0.15 * sum(w in used for w in found)


def defect(question: str | None, reply: str | None) -> str | None:
    """The pair's defect, or None."""
    if is_empty(reply):
        return "empty"
    if is_copied(question, reply):
        return "copied"
    if is_refusal(reply, question):
        return "refusal"
    if is_truncated(reply):
        return "truncated"
    if is_other_language(question, reply):
        return "language"
    return None


@F.pandas_udf(T.StringType())
def _defect(questions: pd.Series, replies: pd.Series) -> pd.Series:
    return pd.Series([defect(q, r) for q, r in zip(questions, replies, strict=True)], dtype=object)


def defective_pairs(chats: DataFrame, key: str = "chat_id", question: str = "question", reply: str = "reply") -> DataFrame:
    """``key, defect`` of every defective pair, once. Only these few rows are shuffled."""
    return chats.select(key, _defect(F.col(question), F.col(reply)).alias("defect")).where(F.col("defect").isNotNull()).distinct()

"""What one answer is, seen beside its prompt: empty, refusal, copy or content.

Copies are found by shingle containment and then the longest common
subsequence of prompt and answer tokens; refusals by aligning the sentences of
a short text without content of its own against refusal templates.
"""

from __future__ import annotations

import re

# What stands for "no answer", without case and punctuation.
PLACEHOLDERS = frozenset("na n/a null none nil nan empty undefined void blank todo tbd tba pending placeholder error missing nooutput noanswer noresponse notext nocontent nodata notavailable notapplicable emptystring emptyresponse lorem 无 空 なし 空白 暂无 没有 該当なし vide leer vacío vacio".split())

# Refusal templates. Words stand in this order within a sentence, with few between; a/b are alternatives.
REFUSALS = {
    "en": """i/i'm/i'd/i've cannot/can't/couldn't/unable/won't/shouldn't/decline/refuse/regret/refrain | i/i'm can/am/will/could/should not | i/i'm/i'd not able/allowed/permitted/comfortable/willing/prepared/going/authorized/authorised/here |
        isn't/not/never something/anything/one i/i'm/i'd/my | must/have/need/going/obliged/forced/like/wish to/respectfully/politely decline/refuse/pass/abstain/refrain/withhold | must/respectfully/politely decline/refuse | i/i'd rather/prefer not |
        impossible/possible/permitted for me | outside/beyond/against/exceeds/violates/contrary my/what/the/scope i/i'm/remit/scope/guidelines/instructions/rules/policy/policies/abilities/capabilities/role/limits |
        my guidelines/instructions/rules/policy/policies/principles/programming not/don't/forbid/prohibit/prevent/rule/won't/keep/stop | sorry/afraid/apologies/apologize/apologise i/this/that/no cannot/can't/not/won't/isn't/unable | this/that isn't/not/won't possible/happen/work for/with me/here""",
    "fr": """je ne peux/puis/saurais/pourrai/souhaite/suis pas/en | je ne peux/puis/saurais | m'est impossible/interdit/défendu | ne m'est pas/guère permis/possible/autorisé | je/dois/devoir/préfère/regrette/contraint/obligé refuser/décliner/renoncer/abstenir/m'abstenir/regret |
        je refuse/décline/m'abstiens/renonce | je préfère ne pas | pas/impossible/interdit pour moi | désolé/désolée/regret je/cela/ce/mais ne/n'est/pas | dépasse/hors/contraire/outrepasse mes/de/à/ce attributions/compétences/consignes/règles/capacités/limites/possibilités/mes/que |
        mes consignes/règles/instructions/principes m'interdisent/interdisent/m'empêchent/empêchent/excluent/ne""",
    "de": """ich kann/darf/werde/möchte/will/könnte leider/das/dies/dazu/dabei/ihnen/diesen/diese/dieses/die/hier/hierzu/nicht/nichts/keine/keinen | kann/darf/werde/möchte/will ich leider/das/dazu/hier/nicht/nichts/keine/keinen/aus | muss/möchte/sehe ich/mich/leider ablehnen/verzichten/verweigern/absagen/passen/gezwungen |
        ich muss ablehnen/verzichten/absagen/passen | ich lehne/verweigere/verzichte/bedaure/bedauere | nicht/außerstande/unmöglich für/mir mich/möglich/gestattet/erlaubt | mir nicht/ist/leider möglich/gestattet/erlaubt/unmöglich/untersagt/verboten |
        nicht in/dazu der/bereit/befugt/berechtigt/imstande lage | bin ich/dazu/leider/nicht nicht/außerstande befugt/bereit/berechtigt/imstande/in | übersteigt/außerhalb/jenseits/gegen meine/meiner/meinen/dessen befugnisse/möglichkeiten/richtlinien/vorgaben/regeln/fähigkeiten/was |
        meine richtlinien/vorgaben/regeln/anweisungen verbieten/untersagen/erlauben/lassen/schließen | tut mir leid nicht/kann/darf/leider""",
    "es": """no puedo/podré/podría/quiero/debo/voy/pienso/sé | no me es/está/resulta/parece posible/permitido/autorizado/viable | me resulta/es imposible | imposible/posible/permitido para mí | no estoy/soy/quedo en/capaz/autorizado/autorizada/dispuesto/dispuesta/facultado |
        debo/tengo/prefiero/quiero/lamento que/rechazar/declinar/negarme/abstenerme/no rechazar/declinar/negarme/abstenerme/poder | debo/prefiero/lamento rechazar/declinar/no/negarme/abstenerme | me niego/abstengo/veo | no se me permite | lo siento no/pero |
        queda/está/va/excede/supera/sale fuera/contra/de/mis/más lo/de/mis/mi que/alcance/competencias/normas/límites/instrucciones/posibilidades/puedo/mi | mis normas/instrucciones/reglas/directrices/principios no/me/lo impiden/prohíben/permiten/excluyen""",
    "it": """non posso/potrò/riesco/intendo/voglio/sono | mi è/risulta impossibile/vietato | non mi è permesso/possibile/consentito | devo/preferisco rifiutare/declinare/non/rinunciare | mi rifiuto/astengo | mi dispiace ma/non""",
    "pt": """não posso/poderei/consigo/devo/vou | não me é permitido/possível | devo/prefiro recusar/declinar/não | recuso/me me/recuso | lamento/desculpe mas/não""",
}
# Refusal phrases of scripts without spaces.
REFUSALS_SPACELESS = tuple(
    """无法完成 无法提供 无法撰写 无法回答 无法处理 无法满足 无法协助 无法帮 无法给出 我无法 不能提供 不能撰写 不能回答 不能处理 不能完成 不能满足 不能协助 不能帮 我不能 我不可以 我不会 我不便 没有办法 没办法 不被允许 不允许我 必须拒绝 只能拒绝 不得不拒绝 我拒绝 拒绝回答 予以拒绝 恕我不能 恕我无法 恕不能 恕难 不方便 不便提供 不便回答 不便撰写 不愿意 宁愿不 超出我 超出了我 不在我的 帮不了 做不到 爱莫能助 谢绝
    お応えできません お答えできません 答えることはできません 書くことはできません 示すことはできません 扱うことはできません 書けません 答えられません 応じられません できかねます いたしかねます しかねます できません わけにはいきません 控えます 控えさせて お断り 拒否 許されていません 認められていません 禁じられています 遠慮 お手伝いできない 対応できない 応じることはできない 私にはできない 差し控え ご容赦""".split()
)
# Courtesies and grounds that go with a refusal and are no content.
COURTESIES = """thank/thanks you/for for/your | please/kindly consult/ask/try/contact/rephrase/see | perhaps/maybe you could/might/may | instructions/rules/guidelines/policies i/that follow/prevent/forbid/allow | you ask/asked/request for/an | merci de/pour votre/cette/cet/ta |
    vous/tu pourriez/pouvez/pourrais reformuler/consulter/demander | consignes/règles que/de je/suivre suis | vous demandez/demandiez un/une | danke/dank für | vorgaben/regeln/richtlinien lassen/erlauben das/dies/es nicht | formulieren/fragen/stellen sie | sie fragen/bitten nach/um |
    gracias por | quizá/quizás/tal pueda/puede/vez reformular/consultar/preguntar | normas/reglas que/me sigo/obligan | usted/me pide/pides un/una | grazie/obrigado/obrigada per/por/pela/pelo"""

_TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_]+(?:['’][^\W_]+)*")
_QUOTED = re.compile(r"“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|「[^「」]*」|『[^『』]*』|\"[^\"\n]*\"|‹[^‹›]*›")
_MATH = re.compile(r"\$\$.*?\$\$|\$[^$]{1,400}?\$", re.S)
_SENTENCE = re.compile(r"[^.!?。！？．｡\n]+")
_WORDLESS = re.compile(r"[\W_]+")


def _templates(text: str) -> list[list[frozenset[str]]]:
    return [[frozenset(w.split("/")) for w in t.split()] for t in " ".join(text.split()).split(" | ")]


_REFUSALS = [t for text in REFUSALS.values() for t in _templates(text)]
_COURTESIES = _templates(COURTESIES)
#: Share of an answer's characters in sentences with formulas or several numbers from which it has content of its own.
CONTENT_SHARE = 0.3


def blank_spans(text: str) -> str:
    """The text with quotations and formulas blanked, positions kept."""
    if "$" in text:
        text = _MATH.sub(lambda m: " " * len(m.group()), text)
    return _QUOTED.sub(lambda m: " " * len(m.group()), text)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower().replace("’", "'"))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row = 0
    for y in b:
        x = row | where.get(y, 0)
        row = x & ~(x - ((row << 1) | 1)) if x else 0
    return row.bit_count()


def copies_prompt(proof: str, prompt: str | None, share: float = 0.85, least: float = 0.4) -> bool:
    """Whether the answer holds nothing but the prompt or the greater part of it, once or several times.

    Shingle containment (two tokens) rules out most answers; then the longest
    common subsequence must cover `share` of the answer and `least` of the prompt.
    """
    if not prompt:
        return False
    a, b = tokens(proof), tokens(prompt)
    if not a or not b:
        return False
    words = set(b)
    if sum(x in words for x in a) < share * len(a):
        return False
    whole = len(b)
    pairs = set(zip(b, b[1:])) | {(b[-1], b[0])}
    if len(a) > 2 and sum(x in pairs for x in zip(a, a[1:])) < 0.35 * (len(a) - 1):
        return False
    # a prompt written several times is taken part by part
    common = sum(lcs_length(a[at : at + 2 * whole], b * -(-min(2 * whole, len(a) - at) // whole)) for at in range(0, len(a), 2 * whole))
    return common >= share * len(a) and (common >= least * whole or len(proof) >= least * len(prompt))


def _aligned(words: list[str], template: list[frozenset[str]], slack: int = 4) -> bool:
    """Whether the template's words occur in order, with few words between."""
    reached = [k for k, w in enumerate(words) if w in template[0]]
    for wanted in template[1:]:
        reached = sorted({k for at in reached for k in range(at + 1, min(len(words), at + 2 + slack)) if words[k] in wanted})
        if not reached:
            return False
    return bool(reached)


def _declines(part: str) -> bool:
    low = part.lower()
    if any(p in low for p in REFUSALS_SPACELESS):
        return True
    words = tokens(part)
    return len(words) >= 2 and any(_aligned(words, t) for t in _REFUSALS)


_SHOWS = re.compile(r"[$=≤≥<>≡∑∏^\\]|\d\D+\d")


def refuses(proof: str) -> bool:
    """Whether the answer declines: a refusal sentence, or two courtesies, and hardly any content beside it.

    Sentences with a formula or several numbers are content; a text that holds
    CONTENT_SHARE of its characters in such sentences answers, whatever else it says.
    """
    # sentences of the text as written: its formulas mark them as content
    parts, shown, held = [], [], 0
    for m in _SENTENCE.finditer(proof):
        parts.append(m.span())
        if _SHOWS.search(m.group()):
            shown.append(m.span())
            held += m.end() - m.start()
            if held > CONTENT_SHARE * len(proof):
                return False
    if not parts or held > CONTENT_SHARE * sum(b - a for a, b in parts):
        return False
    bare = blank_spans(proof)
    plain = [bare[a:b] for a, b in parts if (a, b) not in set(shown)] + [bare[a:b] for a, b in shown]
    if any(map(_declines, plain)):
        return True
    return not shown and sum(any(_aligned(tokens(part), t) for t in _COURTESIES) for part in plain) * 2 >= max(4, len([p for p in plain if tokens(p)]))


def is_empty(proof: str | None) -> bool:
    """Null, or only blanks, punctuation or a placeholder, once or repeated."""
    if proof is None:
        return True
    first = _WORDS.search(proof)
    if not first:
        return True
    if len(proof) <= 60 and _WORDLESS.sub("", proof).lower() in PLACEHOLDERS:
        return True
    if first.group().lower() not in PLACEHOLDERS:
        return False
    return {w.lower() for w in _WORDS.findall(proof)} == {first.group().lower()}


_WORDS = re.compile(r"[^\W_]+")
def nature(proof: str | None, prompt: str | None) -> str:
    """'empty', 'refusal', 'copied' or 'content'."""
    if is_empty(proof):
        return "empty"
    if copies_prompt(proof, prompt):
        return "copied"
    if refuses(proof):
        return "refusal"
    return "content"

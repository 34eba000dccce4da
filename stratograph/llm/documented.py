"""Functions paired with their documentation.

One recursive pattern takes a symbol's source apart: the comment that stands directly above the
header, the header and the balanced body, with strings and comments protected so that brackets in
them do not count. Documentation that says nothing is then filtered out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratograph.session import spread

PAIR_SCHEMA = "id string, name string, signature string, code string, documentation string, origin string"

# Pieces shared by all languages: strings and comments are atoms that the recursion cannot enter.
_ATOMS = r"""
(?(DEFINE)
  (?P<string>\"{3}(?:[^\"\\]|\\.|\"(?!\"\"))*+\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*+'{3}
            |\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`)
  (?P<note>//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)
  (?P<round>\((?:[^()\"'`/]++|(?&string)|(?&note)|(?&round)|[\"'`/])*+\))
  (?P<square>\[(?:[^\[\]\"'`/]++|(?&string)|(?&note)|(?&square)|[\"'`/])*+\])
  (?P<curly>\{(?:[^{}\"'`/]++|(?&string)|(?&note)|(?&curly)|[\"'`/])*+\})
)"""

# Comment lines or blocks, each ended by one line break: a blank line ends "directly above".
BRACED = regex.compile(
    _ATOMS + r"""
(?:[^\S\n]*+(?:(?&note)[^\S\n]*+)?\n)*?
(?P<above>(?:[^\S\n]*+(?:(?&note)|\#(?![\[!])[^\n]*+)[^\S\n]*+\n)*+)
(?:[^\S\n]*+(?:@[\w.]++[^\S\n]*+(?&round)?+|\#?(?&square))[^\S\n]*+\n?)*+
(?P<header>[^\S\n]*+[^\s{};=/\#*\"'`(](?:[^{;\"'`/(]++|(?&string)|(?&note)|(?&round)|/)*+)
(?P<body>(?&curly)|\{.*+|;|\Z)""",
    regex.VERBOSE | regex.DOTALL,
)

INDENTED = regex.compile(
    _ATOMS + r"""
(?:[^\S\n]*+(?:\#[^\n]*+)?\n)*?
(?P<above>(?:[^\S\n]*+\#[^\n]*+\n)*+)
(?:[^\S\n]*+@[\w.]++[^\S\n]*+(?&round)?+[^\n]*+\n)*+
(?P<header>[^\S\n]*+(?:async[^\S\n]++)?(?:def|class)[^\S\n]++\w++[^\S\n]*+(?:\[[^\]\n]*+\])?[^\S\n]*+(?&round)?+[^:\n]*+:)
(?P<body>[^\S\n]*+(?:\#[^\n]*+)?(?:\n[^\S\n]*+(?:\#[^\n]*+)?)*+(?:[rRuU]?(?P<first>(?&string)))?.*+)""",
    regex.VERBOSE | regex.DOTALL,
)

# What marks a line or sentence of a comment as saying nothing.
_PLACEHOLDER = r"""(?:todo|fixme|xxx+|tbd|tba|wip|n/?a|none|nil|null|undocumented|not\ documented|no\ (?:documentation|docs?|description)(?:\ (?:yet|available|provided))?
 |(?:docs?|documentation|description)(?:\ (?:is|are))?\ (?:pending|missing|needed|follows?|to\ follow|to\ come|required)|(?:short\ |brief\ )?description|summary|documentation|docs?|docstring|placeholder|document\ (?:me|this)|add\ (?:docs?|documentation|description)(?:\ here)?
 |deprecated|internal|private|public|lorem\ ipsum.*|fill\ (?:me|this)\ in|insert\ description\ here|coming\ soon|later)"""
_PROMISE = r"""(?:todo|fixme|xxx|hack)\b.*|(?:documentation|docs?|description|comment|details?)\b.*\b(?:will|shall|to)\ be\ (?:added|written|provided|documented|completed)\b.*|(?:will|to)\ be\ (?:documented|described)\b.*|(?:write|add|complete)\ (?:the\ |some\ )?(?:documentation|docs?|description)\b.*"""
_POINTER = r"""see\ (?:above|below|base|parent|super|super\s?class|interface|implementation|the\ (?:parent|base|super|docs?|documentation|interface|source|code|manual|wiki)(?:\ [\w-]+){0,4}|base\ class|parent\ class|also|there|readme|docs?|documentation|[\w.]*[A-Z_.()#][\w.()#]*)
 |(?:for\ (?:more\ )?(?:details?|information)\b.*)?(?:please\ )?(?:refer\ to|consult|look\ at)\ (?:the\ )?(?:documentation|docs?|parent|base|interface|manual|wiki)\b.*|for\ (?:more\ )?(?:details?|information),?\ (?:please\ )?(?:see|refer|consult)\b.*|\{?@inherit_?doc\}?|inherit(?:ed|s)?(?:\ (?:doc(?:s|umentation)?|comment))?\ from\ [\w.]+(?:\ (?:class|interface))?|inherit_?docs?|(?:same|as)\ (?:as\ )?(?:above|below|in\ (?:the\ )?(?:parent|base)(?:\ class)?)|@see\b.*|overrides?\ (?:the\ )?(?:parent|base|super)(?:\ (?:class|method))?|ditto|as\ above"""
_LINT = r"""no[qs]a\b.*|noqa:?.*|nolint\b.*|nosonar\b.*|eslint\b.*|eslint-(?:disable|enable)\b.*|tslint:.*|pylint:.*|flake8:.*|mypy:.*|pyright:.*|type:\ ?ignore.*|ts-(?:ignore|nocheck|expect-error).*|@ts-\w+.*|prettier-ignore.*|(?:istanbul|c8|v8)\ ignore.*|swiftlint:.*|ktlint.*|detekt.*|rubocop:.*|phpcs:.*|@?phpstan-.*|psalm-.*|clang-format\ (?:on|off)|clang-tidy.*|@?formatter:(?:on|off)|cppcheck-suppress.*|fmt:\ (?:on|off|skip)|yapf:.*|isort:.*|pragma:?\ .*|\#?(?:end)?region|resharper\ .*|@?suppress(?:lint|warnings)\b.*|-\*-.*-\*-|vim?:\ .*|go:\w+.*|\+build\ .*|coverage:\ ?ignore.*|lint:.*|rustfmt::skip.*"""
_LICENCE = r"""(?:.*\b)?copyright\b.*|\(c\)\ .*|.*\ball\ rights\ reserved\b.*|.*\blicen[sc]ed\ (?:under|to)\b.*|.*\bspdx-licen[sc]e-identifier\b.*|.*\bpermission\ is\ hereby\ granted\b.*|.*\bterms\ (?:kept\ in|of\ the\ licen[sc]e|and\ conditions)\b.*|part\ of\ the\ [\w-]+\ (?:tree|project|library|package)|.*\bwithout\ warrant(?:y|ies)\b.*|.*\b(?:mit|bsd|apache|gnu)\b.*\blicen[sc]e\b.*|use\ is\ governed\ by\b.*|@?licen[sc]e\b.*|@author\b.*|@version\b.*|@since\b.*|@date\b.*"""
_TOOL = r"""(?:this\ (?:file|code|function|method|class|stub)\ (?:is|was|has\ been)\ )?(?:auto(?:matically)?[\ -]?)?generated\b(?:\ (?:by|from|with|using)\b.*|\ (?:method|code|function|constructor|class|file|stub).*)?|auto[-\ ]?generated\b.*|created\ by\ (?:intellij|eclipse|visual\ studio|xcode|android\ studio|[\w.]+\ on\ [\d/.-]+).*|@generated\b.*|<auto-generated.*|do\ not\ edit\b.*|non-javadoc|\(non-javadoc\).*|(?:go|python|java|javascript|typescript|kotlin|rust|c|c\+\+|cpp|c\#|csharp|swift|php|ruby|scala)\ (?:function|method|class|component|symbol|constructor)\ [\w.$:]+(?:\(\))?"""
_TAG = r"""(?:[@:\\](?:param|parameter|arg|argument|type|return|returns|rtype|raises?|throws?|exception|brief|summary|remarks?|property|field|var|ivar|template|typeparam|yields?|keyword|see|todo|deprecated|override|async|function|method|private|public|memberof|class|constructor|static)\b:?(?:\s*\{[^}]*\})?(?:\s+[$*&]?[\w.\[\]]+)?\s*:?)
 |(?:parameters?|params?|args?|arguments?|returns?|return\ value|raises|throws|yields?|examples?|notes?|attributes|see\ also|usage|warnings?|keyword\ arguments)\s*:?|[$*&]?\w+\s*:\s*|[$*&]?\w+\s+:\s*\w+"""
_EMPTY = regex.compile(rf"(?:{_PLACEHOLDER}|{_PROMISE}|{_POINTER}|{_LINT}|{_LICENCE}|{_TOOL}|{_TAG})\s*[.:;!?…]*", regex.VERBOSE | regex.IGNORECASE)
_MARKS = regex.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!/)|///?!?|//+!?|#+!?|--+|;+)?[ \t]?(.*?)[ \t]*(?:\*+/)?\s*$")
_XML = regex.compile(r"</?(?:summary|remarks|para|returns?|param|exception|example|value|c|code|see|typeparam|p|br|inheritdoc|include|paramref|b|i|ul|li|pre)\b[^<>\n]*>", regex.IGNORECASE)
_WORD = regex.compile(r"[\p{Lu}]+(?![\p{Ll}])|[\p{Lu}]?[\p{Ll}]+|[\p{Lo}\p{Lm}]+|\p{N}+")
#: Words that add nothing to a name.
_FILLER = frozenset(
    "a an the this that it its is are was be does do done did what which whose of for to in on by with and or nothing else just only simply here there says say name named names same as "
    "function functions func method methods class classes component symbol procedure routine member constructor callable helper utility implementation implements definition declaration code object "
    "new async static public private internal def fn fun void main method's function's called".split())
#: Per language the words by which a text points elsewhere, promises or regrets itself, and the words that may stand
#: with them; a sentence of these alone says nothing. (English is described by the expressions above.)
_ELSEWHERE = {
    "de": ("siehe vgl vergleiche oben unten dokumentieren dokumentiert folgt fehlt später geerbt vererbt nachgereicht nachgetragen ergänzen ergänzt ausstehend unbeschrieben platzhalter beschreiben undokumentiert",
           "s a u noch zu zur zum wird werden muss soll ist sind nicht hier mehr weiter bitte ein eine einer der die das den dem des in im von vom aus und oder wie keine kein dokumentation doku beschreibung kommentar basisklasse oberklasse elternklasse "
           "superklasse schnittstelle klasse methode funktion datei handbuch wiki hinzufügen einfügen schreiben automatisch erzeugt generiert vorhanden verfügbar für details einzelheiten diese dieser dieses todo"),
    "fr": ("voir cf dessus dessous documenter documenté documentée compléter complété rédiger remplir venir hérité héritée manquant manquante reporter référer consulter consultez ajouter ajoutée ajouté",
           "ci à a plus haut bas tard documentation doc description commentaire classe parente parent mère base interface méthode fonction fichier manuel wiki faire de du des la le les l d un une sera serait non pas encore aucun aucune généré générée automatiquement "
           "se et ou en dans pour détails information informations même que comme est cette ce ultérieurement bientôt veuillez todo"),
    "es": ("ver véase vease arriba abajo documentar documentado documentada pendiente completar completada heredado heredada falta faltante consulte consultar añadir añadirá agregar agregará escribir",
           "más mas adelante documentación documentacion descripción descripcion comentario clase base padre superclase interfaz método metodo función funcion archivo manual wiki por hacer después tarde luego de del la el los las un una sin no hay generado generada "
           "automáticamente igual que como se será sera en y o para detalles información esta este aún todavía la todo"),
    "pt": ("ver veja vide acima abaixo documentar documentado documentada pendente completar completada herdado herdada falta faltante consulte consultar adicionar adicionada escrever preencher",
           "mais adiante documentação descrição comentário classe base pai superclasse interface método função arquivo manual wiki por fazer depois tarde logo de da do das dos a o as os um uma sem não há gerado gerada automaticamente igual que como será em na no e ou "
           "para detalhes informações esta este ainda todo"),
    "nl": ("zie vgl hierboven hieronder boven onder documenteren gedocumenteerd volgt ontbreekt aanvullen aangevuld toevoegen toegevoegd geërfd overgeërfd overgenomen later raadpleeg beschrijven",
           "nog te documentatie beschrijving commentaar basisklasse bovenliggende ouderklasse superklasse klasse interface methode functie bestand handleiding wiki wordt worden moet van de het een geen niet gegenereerd automatisch in op en of voor details meer informatie "
           "hetzelfde als deze dit is todo"),
    "ru": ("см смотри смотрите выше ниже позже документировать задокументировать документировано дописать дополнить дополнено заполнить описать унаследовано унаследован унаследована отсутствует добавлено добавлена добавить обратитесь",
           "документация документацию документации документацией описание описания описанию комментарий базовый базовом базового базовый базовому родительский родительском родительского родителя родителе класс класса классе классу интерфейс интерфейса интерфейсе метод метода методе "
           "функция функции файл файле руководство wiki вики будет будут не нет пока ещё еще от из в на к и или для как то же подробности подробнее сгенерировано автоматически нужно надо сделать это этот эта этого потом"),
}
_ELSEWHERE = {lang: (frozenset(a.split()), frozenset(a.split()) | frozenset(b.split())) for lang, (a, b) in _ELSEWHERE.items()}
#: The same for languages that do not divide their words, as pieces of text.
_PIECES_ELSEWHERE = (
    "参见 参考 参阅 参照 请见 请看 查看 详见 见 请 上文 上面 上述 下文 下面 以上 以下 文档 文件 说明 描述 注释 父类 基类 超类 接口 类 方法 函数 稍后 以后 之后 日后 待 补充 补 添加 完善 暂无 暂 无 没有 尚未 还未 未 尚 编写 撰写 继承 自 同 的 中 自动 生成 将 会 由 更多 详情 详细 信息 该 此 这 是 在 "
    "されます 上記 下記 同上 ドキュメント 文書 説明 コメント 親クラス 基底クラス スーパークラス 親 基底 クラス インターフェース インターフェイス メソッド 関数 後で 後ほど あとで 記述 記入 追加 予定 作成 書く 書き なし ありません まだ 継承 自動 詳細 詳しく については してください ください します される された する です ます である は を の に が で と も から 要 後日 追記 未 "
    "참조 참고 위의 위 아래 문서화 문서 설명 주석 부모 상위 기본 기반 클래스 인터페이스 메서드 메소드 함수 나중에 나중 추후 추가 예정 작성 필요 없음 없습니다 없다 아직 미정 상속됨 상속 자동 자세한 내용 동일 하십시오 하세요 합니다 입니다 됩니다 바랍니다 해야 할 됨 된 한 을 를 은 는 이 가 의 에서 에 로 으로 와 과 함").split()
_PIECES_ELSEWHERE = regex.compile("|".join(sorted(map(regex.escape, _PIECES_ELSEWHERE), key=lambda x: (-len(x), x))))
_UNDIVIDED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}ー]")
_SENTENCE = regex.compile(r"(?<=[.!?。！？])\s+|\n")


def bare_comment(text: str) -> str:
    """The words of a comment or string literal: marks, quotes and markup removed, lines kept."""
    text = text.strip()
    quoted = regex.fullmatch(r"""[rRuUbBfF]{0,2}(\"{3}|'{3}|\"|'|`)(.*)\1""", text, regex.DOTALL)
    if quoted:
        text = quoted.group(2)
    lines = [_MARKS.sub(r"\1", line) for line in text.split("\n")]
    return _XML.sub(" ", "\n".join(lines)).strip()


def only_points_elsewhere(sentence: str, known: frozenset[str] | set[str] = frozenset()) -> bool:
    """Whether a sentence, in a language of those above, only says that documentation is elsewhere, will come or is missing.

    A pointer may name one thing it points to. ``known``: further words that do not count.
    """
    words = [w.lower() for w in regex.findall(r"[\p{L}\p{M}]+", sentence)]
    held = set(words)
    for mark, all_of in _ELSEWHERE.values():
        if held & mark and len([w for w in words if w not in all_of and w not in known]) <= (words[0] in mark):
            return True
    if _UNDIVIDED.search(sentence):
        rest = _PIECES_ELSEWHERE.sub("", sentence)
        return len(rest) < len(sentence) and not regex.search(r"[\p{Latin}\p{Cyrillic}]{2,}", rest) and len(_UNDIVIDED.findall(rest)) < 2
    return False


def says_something(doc: str | None, name: str | None) -> bool:
    """Whether a documentation text holds more than placeholders, tags, notices and the symbol's own name.

    The text is judged sentence by sentence; one sentence of value is enough. A sentence of value has,
    besides filler words and the words of the name, at least two further words, or one word of
    more than four letters in a script without spaces.
    """
    if not doc or not doc.strip():
        return False
    own = {w.lower() for w in _WORD.findall(name or "")}
    own |= {w + "s" for w in own} | {w + "es" for w in own} | {(name or "").lower(), (name or "").rpartition(".")[2].lower()}
    for sentence in _SENTENCE.split(bare_comment(doc)):
        sentence = sentence.strip(" \t-*#=_~>|/\\")
        if not sentence or not regex.search(r"\p{L}", sentence) or _EMPTY.fullmatch(sentence):
            continue
        # a tag with its text counts by the text
        sentence = regex.sub(r"^[@:\\](?:param|arg|type|returns?|rtype|raises?|throws?|brief|yields?)\b(?:\s+[$*&]?\w+)?\s*:?\s*", "", sentence)
        words = [w for w in _WORD.findall(sentence) if not w.isdigit()]
        left = [w for w in words if w.lower() not in own and w.lower() not in _FILLER]
        if (len(left) >= 2 or any(len(w) > 4 and regex.match(r"[\p{Lo}]", w) for w in left)) and not only_points_elsewhere(sentence, own):
            return True
    return False


def take_apart(code: str, language_hint: str) -> tuple[str, str, str]:
    """(documentation inside the code, header, code without what stands above the header)."""
    if language_hint in ("py", "pyi"):
        m = INDENTED.match(code)
        if not m:
            return "", "", code
        first = bare_comment(m["first"]) if m["first"] else ""
        above = bare_comment(m["above"] or "")
        return "\n".join(x for x in (first, above) if x), m["header"].strip(), code[m.start("header"):]
    m = BRACED.match(code)
    if not m:
        return "", "", code
    return bare_comment(m["above"] or ""), m["header"].strip(), code[m.start("header"):]


def _extension(path: str | None, id_: str) -> str:
    """File extension from the path, or from the path inside an id ``symbol:<path>:<Name>``."""
    return (path or id_.rpartition(":")[0]).rpartition(".")[2].lower()


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for id_, name, signature, docstring, code, path in batch.itertuples(index=False):
            if not id_ or not code or not code.strip():
                continue
            inner, header, bare = take_apart(code, _extension(path, id_))
            if says_something(docstring, name):
                doc, origin = bare_comment(docstring), "docstring"
            elif says_something(inner, name):
                doc, origin = inner, "code"
            else:
                continue
            out.append((id_, name, signature or header, bare, doc, origin))
        yield pd.DataFrame(out, columns=["id", "name", "signature", "code", "documentation", "origin"])


def documented_functions(symbols: DataFrame) -> DataFrame:
    """(id, name, signature, code, documentation, origin), one row per symbol with code and documentation of value.

    The documentation is the ``docstring`` column if that says something, else the comment directly
    above the header or the string that opens the body inside ``code``; comments within the body are
    none. Versions and duplicates of a symbol carry the same texts and give one row. Symbols with
    null or blank code or null id are left out; a null name only means that no words are discounted;
    a null path falls back to the path in the id; a missing signature is taken from the header in
    the code. Empty table, empty result. The texts never move before the filter: each row is worked on where
    it is read, and only pairs kept are shuffled to drop repeats.
    """
    rows = symbols.filter("id IS NOT NULL AND trim(code) <> ''").select("id", "name", "signature", "docstring", "code", "file_path")
    return spread(rows).mapInPandas(_pairs, PAIR_SCHEMA).dropDuplicates(["id"])


def documented_ids(symbols: DataFrame) -> DataFrame:
    """Ids of :func:`documented_functions`: the same operator, but only ids are shuffled."""
    rows = symbols.filter("id IS NOT NULL AND trim(code) <> ''").select("id", "name", "signature", "docstring", "code", "file_path")
    return spread(rows).mapInPandas(_pairs, PAIR_SCHEMA).select("id").distinct()

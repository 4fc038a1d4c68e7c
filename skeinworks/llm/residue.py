"""Leftovers of templates, filler, error pages and script notices in texts.

Three detectors read the whole text.

Placeholders: one grammar for each delimiter. A match does not count inside
code (fences, inline code, command lines, data samples) nor in a sentence that
speaks about templates, unless such sentences are the smaller part of those
with matches.

Filler: runs of Latin filler words of enough density, sentences that are Latin
by their endings and little words, and set phrases that stand for a
description.

Messages: errors, unavailability, and notices that scripts or a browser check
are required; by set phrases, and by structure: a short sentence that gives a
status with a reason, or says of something on the web that it fails. They make a record residue only where they are all of it: after
taking away the messages, what goes with them and page navigation, no more
than ``LEFT_WORDS`` words remain.

Defined results: a null or blank text is no residue; equal texts get equal
results; length has no limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that may remain beside messages, such as a heading.
LEFT_WORDS = 5
#: Latin words in a row, their share in a sentence, and words of Latin alone, that make it filler.
LATIN_RUN, LATIN_SHARE, LATIN_STRONG = 4, 0.6, 3

_NAME = r"[A-Za-z_][\w-]*(?:\.\w+)*"
_FILTER = r"(?:\s*\|\s*\w+(?:\([^()\n]{0,40}\))?|\s+or\s+\w+)*"
_WORDS = r"[^\W\d_][\w'’/-]*(?:[ _][\w'’/-]+){0,5}"
# What fields are called that a template fills.
_FIELDS = "name address price date email e-mail phone telephone company title number no id brand model city state county street zip code url link amount quantity qty sku mpn description product item customer client buyer seller shop store website signature total currency capacity interface condition warranty location logo image text".split()
_FIELD_CAPS = "(?:" + "|".join(sorted((f.upper() for f in _FIELDS), key=len, reverse=True)) + ")"
_FIELD = "(?:" + "|".join(x for f in sorted(_FIELDS, key=len, reverse=True) for x in (f.upper(), f.title())) + ")"
# The grammars of unfilled placeholders, by delimiter.
_PLACEHOLDERS = (
    rf"\{{\{{\{{?\s*[#/^>&!]?\s*(?:\w+\s+){{0,2}}{_NAME}{_FILTER}\s*\}}?\}}\}}",  # {{name}}, {{{name}}}, {{#each names}}
    rf"\{{%-?\s*\w+(?:\s+[\w.]+){{0,6}}\s*-?%\}}",  # {% if name %}
    rf"<%[=-]?\s*{_NAME}{_FILTER}\s*-?%>",  # <%= name %>
    rf"\[\[\s*[A-Za-z][\w .]*\s*\]\]",  # [[NAME]]
    rf"[$#@]\{{\s*(?:{_NAME}|\d{{1,2}}){_FILTER}\s*\}}",  # ${name}, #{name}
    rf"%\({_NAME}\)[sdif]",  # %(name)s
    r"%%\s*[A-Za-z][A-Za-z0-9_]*\s*%%",  # %%NAME%%
    r"(?<![\w%])%[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+%",  # %FIRST_NAME%
    r"@@\s*[A-Za-z][A-Za-z0-9_]*\s*@@",  # @@NAME@@
    r"__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__",  # __NAME__
    r"\*\|\s*[A-Za-z][\w:]*\s*\|\*",  # *|NAME|*
    r"(?<![\w~#^])(?P<mark>[~#^]{1,3}|\$\$?)[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*(?P=mark)(?!\w)",  # ~NAME~, ##NAME##
    r"(?<![\w|!:])(?P<sign>[|!:]{1,3})[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+(?P=sign)(?!\w)",  # ::FIRST_NAME::
    r"<<\s*[A-Za-z][A-Za-z0-9_ ]*\s*>>",  # <<NAME>>
    rf"(?<![\w$#@%{{/\\-])\{{(?:{_NAME}|\d{{1,2}})(?:![rsa])?\}}(?!\}})",  # {name}, {0}
    rf"[\[<](?i:insert|enter|add|type|your|ihre?n?|votre|vos|su|tu|deine?|insertar|inserte|insérer|insérez|inserer|hier|ici|aquí)\s+{_WORDS}[\]>]",  # [Your name], <insert name here>
    rf"[\[<]{_WORDS}\s+(?i:goes here|here|einfügen|eintragen|ici|aquí)[\]>]",  # [name goes here]
    rf"&lt;\s*(?:[a-z][a-z0-9]*(?:[_ .][a-z0-9]+)*)\s*&gt;",  # an escaped <name>
    r"<[a-z][a-z0-9]*(?:_[a-z0-9]+)+>",  # <first_name>
    r"(?<!\w)<[A-Z][a-z]+(?:[A-Z][a-z]+)+>",  # <CustomerName>
    rf"\[(?:(?!\w+(?:ED|ed)\b)[A-Z][\w'’]*[ _]){{0,3}}{_FIELD}\]",  # [CUSTOMER NAME]
    rf"[«‹]\s*(?:[a-z][a-z0-9]*(?:_[a-z0-9]+)+|(?:[A-Z]+[ _]){{0,3}}{_FIELD_CAPS})\s*[»›]",  # «first_name», «CUSTOMER NAME»
    rf"\(\(\s*(?:[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+|(?:\w+[ _]){{0,3}}{_FIELD})\s*\)\)",  # ((first_name))
    rf"(?<![\w$])\$(?:[A-Z][A-Z0-9]*_)+(?:{_FIELD_CAPS}|PLACEHOLDER)\b",  # $CUSTOMER_NAME
)
_PLACEHOLDER = re.compile("|".join(f"(?:{p})" for p in _PLACEHOLDERS))
#: Where a placeholder can begin.
_HINT = re.compile(r"(?=[$#@]?\{|\[|<|[«‹]|\(\(|%(?=[({%A-Z])|@@|\*\||__(?=[A-Z])|&lt;|[~#^$|!:]+[A-Z])")
#: Fences and tags run over lines; an indented block goes on while its lines are indented, a command ends with its line.
_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|<(code|pre)\b.*?(?:</\1>|\Z)|`[^`\n]+`|^(?: {4}|\t)\S[^\n]*(?:\n(?:(?: {4}|\t)[^\n]*|[ \t]*(?=\n)))*|^[^\S\n]*(?:\$|>>>|#!)[^\S\n][^\n]*", re.S | re.M | re.I)
# Words of a sentence that speaks about templates.
_ABOUT = re.compile(r"\b(?:templates?|placeholders?|syntax|variables?|merge (?:fields?|tags?)|curly|braces|brackets|double quotes|mustache|jinja|handlebars|liquid|e\.g\.|for example|such as|literally|snippet|platzhalter|vorlage|zum beispiel|z\. ?b\.|modèle|par exemple|plantilla|marcador|por ejemplo)\b", re.I)

# The words of Latin filler; those that other languages share count only beside the others.
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
_SHARED = frozenset("et in ex ad id est non sit qui ut ea sed dolor".split())
_STRONG = _LATIN - _SHARED
# Endings of Latin words that living languages seldom have, little words of Latin, and little words of living languages.
_LATIN_END = re.compile(r"(?:us|um|unt|ntur|tur|ae|orum|arum|ibus|isse|que|iam|imus|amus|erit|erunt|itas|atis)$")
_LATIN_LITTLE = frozenset("et in ad non ut qui quae quod cum sed ex de est sunt atque nec vel per ab pro quam at aut si ac eos hic neque nam enim quia ita etiam tamen ubi sic sit quos quis ipsa ipsam ipsum unde".split())
_LIVING = frozenset("the of and is are for to with a an this that it on by from or as be was we you our your der die das und ist mit von für ein eine nicht zu den im auf le la les des une du est pas pour avec sur dans que el los las una por con para del se no es y en il di che".split()) - frozenset("est que non in".split())
#: Words of a sentence of unknown Latin, the share of them with Latin endings, and the share of little words of Latin.
LATIN_WORDS, LATIN_ENDS, LATIN_SMALL = 8, 0.25, 0.1
#: The share of little words that tells Latin with few such endings.
LATIN_MANY_SMALL = 0.3
#: Words of which any filler of Latin holds one.
_LATIN_ONLY = _STRONG | (_LATIN_LITTLE - frozenset("et in ad non ut qui ex de est per si at sed cum pro sic que".split()))

# Phrases that stand in the place of a description, each with parts of which a text must hold one before the phrase is looked for.
_KIND = r"(?:text|copy|description|details?|content|paragraph|heading|title|story|body|caption|headline|subtitle)"
_START = r"(?:^|(?<=[.!?\n]) ?)\W{0,12}"
_MADE_UP = ("draft", "example", "sample", "dummy", "filler", "placeholder")
_FILLERS = (
    ("goes here", rf"\b(?:your|the|some)? ?{_KIND} goes here\b"),
    (" here", rf"\b(?:your|type|enter|write|insert|add|put) (?:(?:your|the|some|a) )?(?:\w+ )?{_KIND} here\b"),
    ("story in this", r"\b(?:add|tell|write) your \w+ story in this (?:block|section)\b"),
    ("use this ", r"\buse this (?:section|area|block|space|text) to (?:tell|share|describe|explain|welcome|add)\b"),
    ("heading ", rf"{_START}heading (?:one|two|three|[1-6])\s*(?:[.!\n]|$)"),
    ("coming soon|to follow|to be added|to come|to be announced|follows soon|pending", rf"\b{_KIND} (?:is |are )?(?:coming soon|to follow|to be added|to come|to be announced|follows soon|pending)\b"),
    ("shortly|soon|later|in due course|in a few days|asap", rf"\b{_KIND} (?:will|shall|is going to|to) (?:be |follow\b ?|come\b ?)?(?:added|updated|provided|supplied|written|completed|uploaded|inserted|posted|published|finished|filled in)?[ ,]*(?:here )?(?:very )?(?:shortly|soon|later|in due course|in a few days|asap)\b"),
    ("this is ", rf"\bthis is (?:a |an |some )?(?:filler|placeholder|dummy|sample|example|draft|blind) {_KIND}\b"),
    ("|".join(f"{w} " for w in _MADE_UP), rf"{_START}(?:draft|example|sample|dummy|filler|placeholder) {_KIND}\s*(?:[.!,;\n]|$)"),
    ("before publi|before going live|before launch|before release", r"\b(?:change|replace|edit|update|remove)(?: this| me)?(?: text| copy)? before (?:publishing|going live|launch|publication|release)\b"),
    ("dummy text", r"\b(?:dummy text)(?:[,. ]+dummy text)+"),
    ("todo|fixme|tbd", r"\b(?:TODO|FIXME|TBD)\s*[:-]\s*(?:write|add|fill|insert|replace|update|describe|text|copy|body|description)\b"),
    ("asdf|qwer|jkl", r"\b(?:asdf|qwer|jkl|qwerty)(?:\s+(?:asdf|qwer|jkl|qwerty))+\b"),
    ("xxx", r"\bx{3,}(?:\s+x{3,}){1,}\b"),
    ("test", r"\btest(?:\s+test){2,}\b"),
    ("hier steht|hier kommt|hier folgt", r"\bhier (?:steht|kommt|folgt) (?:später |bald )?(?:der|die|das|ihr|ein) \w+"),
    ("beschreibung folgt|text folgt|details folgt|inhalt folgt", rf"{_START}(?:weitere )?(?:beschreibung|text|details|inhalt) folgt(?: in kürze| bald)?\s*(?:[.!\n]|$)"),
    ("blindtext|platzhalter|fülltext|mustertext|beispieltext", r"\bdies(?:er text)? ist (?:ein|nur ein) (?:blindtext|platzhalter|platzhaltertext|fülltext|mustertext|beispieltext)\b"),
    ("votre ", r"\bvotre (?:texte|description|titre) (?:va )?ici\b"),
    ("à venir|à suivre|bientôt disponible", r"\b(?:description|texte|détails) (?:à venir|à suivre|bientôt disponible)"),
    ("ceci est", r"\bceci est un (?:faux[ -]texte|texte (?:de remplissage|d['’]exemple|provisoire|factice))"),
    ("aquí", r"\b(?:su|tu) (?:texto|descripción|título) (?:va )?aquí"),
    ("próximamente|pendiente|en breve", r"\b(?:descripción|texto|detalles) (?:próximamente|pendiente|en breve)"),
    ("este es un texto", r"\beste es un texto (?:de relleno|de ejemplo|provisional|ficticio)"),
)
_FILLER = tuple((tuple(keys.split("|")), re.compile(pattern, re.I | re.M)) for keys, pattern in _FILLERS)

_THING = r"(?:page|site|website|web ?site|shop|store|storefront|listing|offer|lot|item|product|map|gallery|service|url|content|view|auction)"
_JS = r"(?:java ?scripts?|js|scripts?|scripting)"
_OFF = r"(?:switched off|turned off|disabled|blocked|deactivated|not enabled|off|inactive)"
_HTTP = r"(?:http(?:/\d\.\d)?\s+)?(?:status\s+|error\s+|code\s+)*"
# Messages of errors and unavailability, and notices about scripts and browser checks.
_MESSAGES = (
    rf"{_HTTP}\b[45]\d\d\b\s*(?:[-:–]\s*)?(?:internal server error|service (?:temporarily )?unavailable|bad gateway|gateway time-?out|forbidden|unauthorized|bad request|too many requests|gone|(?:{_THING}s? )?not found)",
    r"\b(?:internal server error|bad gateway|gateway time-?out|service (?:temporarily |is temporarily |currently )?unavailable)\b(?:\s*-\s*request \d+)?",
    r"\bupstream (?:request timeout|connect error)[^\n.]*",
    rf"\b(?:the )?requested (?:url|page|resource)[^\n.]{{0,60}} (?:was )?not found on this server",
    rf"\b(?:error\s+)?404\b\s*[-:–]?\s*(?:{_THING}\s+)?not found",
    rf"(?:^|(?<=[.!?\n:]) ?|\d )\W{0,12}{_THING} not found\s*(?:\(\d+\))?\s*(?:[.!\n]|$)",
    rf"\b(?:sorry|hmm|oops|whoops|uh-oh)?[,:! ]*we (?:can['’]?t|cannot|could not|couldn['’]?t|were unable to) (?:find|locate) (?:this|that|the) {_THING}(?: you (?:requested|wanted|were looking for))?",
    rf"\bthe {_THING} you (?:are looking for|were looking for|requested|wanted) (?:has|was|is|does|could)[^\n.]{{0,60}}",
    rf"\bthis {_THING} (?:is|has been) (?:currently |temporarily |now )?(?:down for maintenance|under maintenance|closed right now|closed|paused|unavailable|suspended|offline|no longer available)(?: right now)?",
    r"\bsomething went wrong(?: on our (?:end|side))?(?: while loading this \w+)?",
    r"\bthe server (?:met|encountered) an (?:unexpected condition|internal error)[^\n.]*",
    r"\ban? (?:unexpected|internal|unknown) error (?:has )?occurred",
    r"\berror establishing a database connection\b",
    r"\bfatal error: [^\n]+",
    r"\btraceback \(most recent call last\):?",
    r"^\s*file \"[^\"\n]+\", line \d+(?:, in \S+)?",
    r"\b(?:[a-z_]\w*\.)+[a-z]\w*(?:exception|error): [^\n]*",
    r"(?:^|(?<=\s))(?:key|value|type|index|attribute|runtime|name|import)error: [^\n]*",
    r"^\s*at [\w.$<>]+\([\w.]+(?::\d+)?\)",
    r"\{\s*\"(?:error|errors|message|status)\"\s*:\s*(?:\{[^{}\n]*\}|\[[^\[\]\n]*\]|\"[^\"\n]*\"|\d+)(?:\s*,\s*\"\w+\"\s*:\s*(?:\"[^\"\n]*\"|\d+|null|true|false))*\s*\}",
    r"(?:^|(?<=[.!?\n]) ?|error )\W{0,12}(?:access|permission) denied\s*(?:[.!\n]|$)",
    r"\byou (?:do not|don['’]?t) have permission to (?:view|access) this \w+",
    r"\byou are not allowed to (?:view|access) this \w+",
    r"(?:^|(?<=[.!?\n]) ?)\W{0,12}(?:request blocked|too many requests)\s*(?:[.!\n]|$)",
    r"\byou have been (?:rate limited|blocked|logged out)[^\n.]*",
    r"\byour session (?:has )?(?:ended|expired|timed out)",
    # in other languages
    r"\b(?:es ist )?ein (?:interner|unerwarteter|unbekannter) (?:server)?fehler (?:ist )?aufgetreten",
    r"\bseite (?:wurde )?nicht gefunden(?: \(\d+\))?",
    r"(?:^|(?<=[.!?\n]) ?)\W{0,12}zugriff (?:verweigert|nicht erlaubt)",
    r"\b(?:der dienst|dieser dienst|diese seite|der shop|dieser shop) ist (?:derzeit|momentan|vorübergehend|zurzeit|zur zeit) nicht (?:verfügbar|erreichbar)",
    r"\berreur \d{3}\b\s*[:–-]?[^\n.]*",
    r"(?:^|(?<=[.!?\n]) ?)\W{0,12}(?:page (?:introuvable|non trouvée)|accès (?:refusé|interdit))",
    r"\b(?:le|ce) (?:service|site) est (?:momentanément|temporairement|actuellement) indisponible",
    r"\bune erreur (?:interne |inattendue )?(?:s['’]est produite|est survenue)",
    r"\berror \d{3}\b\s*[:–-]\s*no (?:encontramos|se encontró|existe)[^\n.]*",
    r"(?:^|(?<=[.!?\n]) ?)\W{0,12}(?:página no encontrada|acceso (?:denegado|prohibido))",
    r"\bel servicio no está disponible(?: en este momento)?",
    r"\bse (?:ha producido|produjo) un error",
    # scripts and browser checks
    rf"\b(?:this|the|our) {_THING}(?: \w+)? (?:requires?|needs?|depends on|relies on|works only with) {_JS}(?: to (?:run|work|load|function))?",
    rf"\b(?:please )?(?:you (?:need|have|must)(?: to)? )?(?:enable|permit|activate|allow|turn on|switch on) (?:{_JS}|cookies)(?: and (?:{_JS}|cookies))?(?: in your browser)?(?: (?:to|before)[^\n.]{{0,60}})?",
    rf"\b{_JS} (?:seems? to be|appears? to be|is|are) {_OFF}(?: (?:in your browser|on this device|in this browser))?",
    rf"\b{_JS}(?: and cookies)? (?:is|are) required(?: to[^\n.]{{0,60}})?",
    rf"\bcookies and {_JS} are required",
    rf"\bfor full functionality of this site[^\n.]*",
    rf"\byour browser (?:does not|doesn['’]t) support {_JS}[^\n.]*",
    rf"\bnoscript\s*:[^\n.]{{0,80}}(?:without|requires|needs) {_JS}",
    r"\b(?:checking|verifying) your browser[^\n.]*",
    r"\b(?:please )?(?:verify|confirm|prove)(?: that)? you are (?:a )?(?:human|not a robot)",
    r"\bdiese (?:seite|website|karte) (?:benötigt|braucht|erfordert) (?:java ?script|skripte|scripts)",
    r"\b(?:bitte )?aktivieren sie (?:java ?script|skripte|scripts|cookies)[^\n.]*",
    r"\bjava ?script (?:ist|wurde) (?:deaktiviert|ausgeschaltet|abgeschaltet|blockiert)[^\n.]*",
    r"\b(?:ce|cette) (?:site|page|boutique|carte) (?:a besoin de|nécessite|requiert|exige) (?:de )?(?:scripts?|java ?script)[^\n.]*",
    r"\b(?:veuillez |merci d['’])?activez? (?:java ?script|les scripts)[^\n.]*",
    r"\bveuillez activer (?:java ?script|les scripts|les cookies)[^\n.]*",
    r"\b(?:activ[ea]|habilite|active) (?:java ?script|los scripts)[^\n.]*",
    r"\besta (?:página|tienda) (?:requiere|necesita) (?:scripts?|java ?script)[^\n.]*",
)
#: Parts of which every message but a line of a stack, a status or a structure holds at least one.
_MESSAGE_KEYS = tuple(
    "server error|service |bad gateway|gateway time|forbidden|unauthorized|bad request|too many requests|gone|not found|upstream|requested url|requested page|requested resource|find th|locate th|looking for|you requested|you wanted|maintenance|closed|paused|unavailable|suspended|offline|no longer available|something went wrong|unexpected condition|internal error|error has occurred|error occurred|database connection|fatal error|traceback|file \"|exception|error: |\"error|\"message|\"status|denied|permission|not allowed|request blocked|rate limited|blocked|logged out|your session|fehler|nicht gefunden|zugriff|nicht verfügbar|nicht erreichbar|erreur|introuvable|non trouvée|accès|indisponible|no encontramos|no se encontró|no existe|no encontrada|acceso|no está disponible|un error|script|js|skript|cookies|your browser|full functionality|robot|human".split("|")
)
_STACK = re.compile(r"at [\w.$<>]+\([\w.]+(?::\d+)?\)")
_MESSAGE = re.compile("|".join(f"(?:{p})" for p in _MESSAGES), re.I | re.M)
# What goes with messages, and page navigation. It counts only beside a message.
_BESIDE = (
    r"\b(?:please )?(?:try|retry)(?: again)?(?: later| in a (?:moment|minute|few \w+)| (?:after|in) \d+ \w+)",
    r"\b(?:please )?(?:reload|refresh)(?: (?:once it is on|the page|this page))?\b",
    r"\btry (?:searching the shop|another search)(?: or go back home)?",
    r"\bslow down and try again in \d+ \w+",
    r"\bthis takes up to \d+ seconds",
    r"\bwe will be back at [^\n.]{1,12}",
    r"\bcome back (?:soon|later)",
    r"\bwe have been notified",
    r"\bplease (?:sign|log) in(?: again)?(?: to (?:continue|see this \w+|view this \w+))?",
    r"\bjust a moment(?:\.{2,3}|…)?",
    r"\b(?:incident|reference|referencia|référence|vorgang|request|ray|request id)\s*(?:id\s*)?[:#]?\s*[\w.#-]*\d[\w.-]*",
    r"\b(?:oops|whoops|sorry|hmm|uh-oh)\b[!.,:]?",
    r"\bbitte versuchen sie es (?:in \d+ \w+ )?(?:erneut|später)(?: erneut)?",
    r"\bdas (?:angebot|produkt) wurde (?:verschoben|entfernt|beendet)(?: oder \w+)?",
    r"\bréessayez dans \d+ \w+",
    r"\bintente de nuevo en \d+ \w+",
    r"\bhome(?: ?[|>/·•] ?\w+)+",
    r"^\W{0,12}(?:search|cart(?: \(\d+\))?|home|shop|contact|menu|sign in|log in|login|register|account|checkout|skip to content|back to (?:results|top|shop|home)|help|about|faq|privacy|terms|imprint|impressum)\W{0,12}$",
    r"\b(?:skip to content|back to results|cart \(\d+\))",
    r"©[^\n.]{0,60}",
    r"^\W*[\w-]+/\d[\d.]*\W*$",
)
_ANY_BESIDE = re.compile("|".join(f"(?:{p})" for p in _BESIDE), re.I | re.M)
# Messages by structure: a sentence that says of something on the web that it fails, by words of four languages.
# Things on the web, what happens to them, what scripts are called and what is said of them, and what the reader is to do.
_SUBJECT = r"\b(?:pages?|(?:web ?)?sites?|servers?|services?|shop|store|storefront|app|application|connection|requests?|session|access|resource|urls?|link|host|hostname|gateway|proxy|database|listing|offer|item|product|lot|map|gallery|view|content|account|ip|address|auction|document|file|seite|website|dienst|anwendung|verbindung|anfrage|sitzung|zugriff|zugang|datenbank|angebot|artikel|karte|serveur|boutique|connexion|requête|accès|base de données|annonce|offre|carte|página|sitio|servidor|servicio|tienda|conexión|solicitud|sesión|acceso|base de datos|anuncio|oferta|mapa|navigateur|navegador|browser|parts? of (?:the|this) page)\b"
_FAILING = r"(?:\bnot (?:be )?(?:found|available|reachable|authori[sz]ed|allowed|responding|exist|shown|displayed|loaded|reached|processed|completed)\b|\bcan(?:['’]?t|not)(?: be)? (?:found|find|reached|reach|displayed|display|loaded|load|shown|show|opened|open|connect|processed|process|completed)\b|\bcould(?: not|n['’]?t)(?: be)? (?:found|find|reached|reach|displayed|loaded|load|shown|opened|connect|processed|completed)\b|\b(?:un|in)available\b|\boffline\b|\bout of service\b|\bmaintenance\b|\btim(?:ed?|ing)[ -]?out\b|\bexpired\b|\b(?:has|have) ended\b|\bdenied\b|\brefused\b|\bblocked\b|\bforbidden\b|\bunauthori[sz]ed\b|\brejected\b|\bfailed\b|\bwent wrong\b|\bdoes(?: not|n['’]?t) exist\b|\bno longer (?:exists?|available|here)\b|\b(?:has|have) been (?:removed|moved|deleted|suspended|disabled|limited|closed|blocked)\b|\boverloaded\b|\berrors?\b|\bbad (?:gateway|request)\b|\btoo many requests\b|\brate limit|\bnicht (?:gefunden|verfügbar|erreichbar|erlaubt|gestattet|geladen|angezeigt|geöffnet)\b|\babgelaufen\b|\bverweigert\b|\bgesperrt\b|\bfehlgeschlagen\b|\bfehler\b|\bexistiert nicht\b|\bwurden? (?:entfernt|verschoben|gelöscht|beendet)\b|\bwartung|\b(?:ab|aus)geschaltet\b|\bintrouvable|\bnon trouvée?\b|\bindisponible|\bexpirée?\b|\brefusée?\b|\binterdit|\bbloquée?\b|\béchoué|\bn['’]existe (?:pas|plus)\b|\berreur\b|\bdésactivée?s?\b|\bno (?:se )?(?:encontr\w+|encuentra|existe|está disponible|disponible)\b|\bcaducad[oa]|\bexpirad[oa]|\bdenegad[oa]|\bprohibid[oa]|\bbloquead[oa]|\bfalló\b|\bmantenimiento\b|\bdesactivad[oa]s?\b)"
_SCRIPT_SAID = rf"\b(?:{_JS}|java-script|cookies|skripte?|los scripts|les scripts)\b"
_SCRIPT_NEED = r"\b(?:without|requires?|required|needs?|needed|enable[ds]?|activat\w+|allow|permit|turn(?:ed)? o[nf]f?|switch(?:ed)? o[nf]f?|disabled|blocked|off|support\w*|depends?|relies|ohne|benötigt|braucht|erfordert|aktivier\w+|abgeschaltet|ausgeschaltet|deaktiviert|sans|nécessite|requiert|exige|besoin|activez|activer|désactivée?s?|sin|requiere|necesita|active|activa|habilite|desactivad[oa]s?)\b"
_CHECK = r"\b(?:verify|verifying|checking|confirm|prove|security check|captcha|challenge)\b[^\n]*\b(?:human|robot|bot|browser|connection|captcha|cloud)\b|\bcaptcha\b"
_STATUS = r"(?<![\d.,$€£-])(?:[45]\d\d|10\d\d)(?![\d.,]*\d)"
_REASON = r"(?:\bhttp\b|\berror\b|\bstatus\b|\bcode\b|\bproxy\b|\bfehler\b|\berreur\b)"
_TO_DO = r"\b(?:try|retry|reload|refresh|wait|come back|go back|go to|return to|check (?:the|your)|contact (?:us|support|the)|log ?in|sign ?in|log in again|clear your|erneut|später|neu laden|melden sie sich|réessayez|actualisez|reconnectez|revenez|intente|inténtelo|recargue|vuelva|inicie)\b"
#: Words of a sentence that tells about somebody or asks, which no message does.
_TELLING = re.compile(r"\b(?:i|i['’]m|i['’]ve|my|me|mine|he|she|him|his|her|they|their|told|tells|said|says|saying|asked|used to|yesterday|last (?:week|month|year)|ich|mein\w*|er|sie hat|je|j['’]ai|mon|ma|mes|yo|mi|mis|also|even|still|once|so|because|although|but|until|came|works? (?:with(?:out)?|fine))\b|\?\s*$", re.I)
_SUBJECTS, _FAILS, _SCRIPTED, _NEEDED = (re.compile(x, re.I) for x in (_SUBJECT, _FAILING, _SCRIPT_SAID, _SCRIPT_NEED))
_CHECKED, _STATUSES, _REASONS, _TO_DOS = (re.compile(x, re.I) for x in (_CHECK, _STATUS, _REASON, _TO_DO))
#: Words that a sentence of a message has at most, and a status line.
MESSAGE_WORDS, STATUS_WORDS = 22, 12
_QUOTED = re.compile(r"[\"“”„«»]")


def _says_failure(sentence: str) -> bool:
    """Whether a sentence is a message by its structure: a status with a reason, a thing on the web that fails, a need for scripts, a check of the browser."""
    n = len(_WORD.findall(sentence))
    if not n or n > MESSAGE_WORDS or _TELLING.search(sentence) or _QUOTED.search(sentence):
        return False
    if n <= STATUS_WORDS and _STATUSES.search(sentence) and (_REASONS.search(sentence) or _FAILS.search(sentence)):
        return True
    if _SCRIPTED.search(sentence) and _NEEDED.search(sentence) or _CHECKED.search(sentence):
        return True
    return bool(_FAILS.search(sentence) and _SUBJECTS.search(sentence))


_WORD = re.compile(r"[^\W_]+")
_STOP = re.compile(r"(?<=[.!?])\s+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


def _sentence(text: str, start: int, end: int) -> str:
    a = max(text.rfind(mark, 0, start) for mark in (". ", "! ", "? ", "\n"))
    b = min((x for x in (text.find(mark, end) for mark in (". ", "! ", "? ", "\n")) if x >= 0), default=len(text))
    return text[a + 1 : b + 1]


def _data_sample(text: str, start: int, end: int) -> bool:
    """Whether a single-brace match is part of code or of a serial, not a gap in a sentence."""
    before, after = text[max(0, start - 2) : start], text[end : end + 2]
    return bool(re.search(r"[\w)\]]$", before) and re.match(r"[({;=]", after)) or ":" in text[start:end] or '"' in text[start:end]


def has_placeholder(text: str) -> bool:
    """Whether a placeholder that was to be filled is left in ``text``."""
    tried = (_PLACEHOLDER.match(text, h.start()) for h in _HINT.finditer(text))
    found = [m for m in tried if m and not _data_sample(text, m.start(), m.end())]
    if not found:
        return False
    code = [m.span() for m in _CODE.finditer(text)]
    found = [m for m in found if not any(a <= m.start() < b for a, b in code)]
    about = sum(1 for m in found if _ABOUT.search(_PLACEHOLDER.sub(" ", _sentence(text, m.start(), m.end()))))
    return len(found) > 2 * about if about else bool(found)


def has_filler(text: str) -> bool:
    """Whether filler stands in ``text`` for a description."""
    low, held = text.lower(), _folded(text)
    if any(pattern.search(text) for keys, pattern in _FILLER if any(k in held for k in keys)):
        return True
    if _LATIN_ONLY.isdisjoint(_WORD.findall(low)):
        return False
    for s in _SENTENCE.finditer(low):
        words = _WORD.findall(s[0])
        latin = [w in _LATIN for w in words]
        run = best = strong = 0
        for w, is_latin in zip(words, latin, strict=True):
            run = run + 1 if is_latin else 0
            best = max(best, run)
            strong += w in _STRONG
        if strong >= LATIN_STRONG and (sum(latin) >= LATIN_SHARE * len(words) and len(words) >= LATIN_RUN or best >= 2 * LATIN_RUN):
            return True
        if len(words) >= LATIN_WORDS and not _LIVING.intersection(words):
            ends, little = sum(bool(_LATIN_END.search(w)) and len(w) > 3 for w in words), sum(w in _LATIN_LITTLE for w in words)
            if ends >= LATIN_ENDS * len(words) and little >= LATIN_SMALL * len(words) or ends and little >= LATIN_MANY_SMALL * len(words):
                return True
    return False


def _folded(text: str) -> str:
    """``text`` in lower case, with the letters that patterns without case take for i, k and s."""
    if not text.isascii():
        text = text.replace("\u0130", "i").replace("\u0131", "i").replace("\u017f", "s")
    return text.lower()


#: Parts of which every sentence that goes with messages, and every one that is a message by structure, holds at least one.
_MORE_KEYS = tuple(
    "try|reload|refresh|slow down|this takes|we will be|come back|been notified|sign in|log in|login|log ?in|just a moment|incident|reference|referencia|référence|vorgang|request|ray|oops|whoops|sorry|hmm|uh-oh|bitte versuchen|wurde|réessayez|intente|home|search|cart|shop|contact|menu|register|account|checkout|skip to|back to|help|about|faq|privacy|terms|imprint|impressum|©|/|not |can't|can’t|cannot|cant |couldn|could not|available|offline|out of service|time|expired|ended|refused|unauthori|rejected|failed|doesn|does not|no longer|been |overload|bad |too many|rate limit|nicht |abgelaufen|verweigert|gesperrt|fehl|wartung|geschaltet|expir|refus|interdit|bloqu|échou|exist|désactiv|no |caducad|denegad|prohibid|fall|mantenimiento|desactivad|http|status|code|proxy|verify|checking|confirm|prove|captcha|challenge|security check|wait|go back|go to|return|check|clear|erneut|später|neu laden|melden|actualisez|reconnect|revenez|inténtelo|recargue|vuelva|inicie|error|went wrong|blocked|forbidden".split("|")
)
#: Parts of lines in which a message can run over the ends of sentences.
_WIDE = ("{", "error:", "exception", "traceback", "file \"")


def _may_be_message(text: str) -> bool:
    """Whether not too many words stand in sentences that hold no part of a message or of what goes with it."""
    left = 0
    for line in _folded(text).splitlines():
        wide = any(k in line for k in _WIDE) or _STACK.search(line)
        for part in (line,) if wide else _STOP.split(line):
            if not wide and not any(k in part for k in _MESSAGE_KEYS) and not any(k in part for k in _MORE_KEYS):
                left += len(_WORD.findall(part))
                if left > LEFT_WORDS:
                    return False
    return True


def is_message(text: str) -> bool:
    """Whether ``text`` is nothing but messages, what goes with them, and page navigation."""
    return _may_be_message(text) and _only_messages(text)


def _only_messages(text: str) -> bool:
    left = hits = 0
    for line in text.splitlines():
        if "?" in line and not any(k in _folded(line) for k in _WIDE):  # a question is no message
            sentences = _STOP.split(line)
            asked = [x for x in sentences if x.rstrip().endswith("?")]
            left += sum(len(_WORD.findall(x)) for x in asked)
            line = " ".join(x for x in sentences if not x.rstrip().endswith("?"))
        rest, n = _MESSAGE.subn(" \n ", line)
        hits += n
        for sentence in _STOP.split(rest):
            if _says_failure(sentence):
                hits += 1
                continue
            if _TO_DOS.search(sentence) and len(_WORD.findall(sentence)) <= MESSAGE_WORDS and not _TELLING.search(sentence):
                continue
            left += len(_WORD.findall(_ANY_BESIDE.sub(" ", sentence)))
        if left > LEFT_WORDS:
            return False
    return hits > 0


def kinds(text: str | None) -> list[str]:
    """The kinds of residue in ``text``: placeholder, filler, message."""
    if not text or not text.strip():
        return []
    checks = (("placeholder", has_placeholder), ("filler", has_filler), ("message", is_message))
    return [name for name, check in checks if check(text)]


def marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kinds): the rows of ``docs`` whose text holds residue."""
    kind = docs.schema[key].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [kinds(t) for t in batch.column(1).to_pylist()]
            keep = [i for i, k in enumerate(got) if k]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([got[i] for i in keep], pa.list_(pa.string()))], names=["key", "kinds"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(scan, f"key {kind.simpleString()}, kinds array<string>").withColumnRenamed("key", key)

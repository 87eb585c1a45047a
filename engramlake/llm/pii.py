"""Personal information inside free text (problem 2).

Anchor expansion: one Aho-Corasick pass over a text finds at-signs, pairs of
digits, street words, known names and the cues that introduce names, numbers
and papers. The parsers of an anchor's kind expand from there, however far, to
the boundaries of what stands there; they read the anchor's paragraph (names: its clause),
which nothing of a kind crosses, and no other part of the text. Numbers are
validated: an identity number that nothing announces must have a right check
digit or letter or lie in a range that is given out, a telephone number the
length of its country. What a person calls an identity number or a telephone
number is taken as one even if it does not validate, since a mistyped number
tells as much. Texts written with look-alikes, full-width forms or invisible
characters are parsed in their canonical form, with positions kept for the
replacement.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm.canonical import transducer
from engramlake.llm.names import COMMON, GIVEN, HAN_DOUBLE, HAN_SURE, ONLY_SURNAMES, SHARED, SURNAMES

KINDS = ("person", "email", "phone", "id_number", "address")

# The cues of each kind, in lower case. A parser decides what they are worth.
ANCHORS = {
    "email": ("@", "(at)", "[at]", "{at}", " at ", "mailto:", " arroba ", " arobase "),
    "phone": (
        "phone", "tel", "call", "mobile", "number is", "text me", "whatsapp", "fax", "handy", "móvil", "portable", "appelez", "llama",
        "手机", "电话", "微信", "打", "+", "555", "０", "0044", "0049", "0033", "0086", "numéro", "nummer", "número", "móvil", "ruf mich", "joindre", "座机", "热线", "号码",
    ),
    "id_number": (
        "ssn", "social", "passport", "passeport", "pasaporte", "reisepass", "id card", "resident id", "identity", "national id", "id no", "dni", "nie ",
        "ausweis", "sécurité sociale", "steuer-id", "身份证", "证件", "护照", "identité", "cni", "seguridad social", "cédula", "nif ", "versicherungsnummer", "identifikationsnummer", "national insurance", "社保",
    ),
    "address": (
        " road", " rd", " street", " st", " avenue", " ave", " lane", " ln", " close", " court", " ct", " blvd", " boulevard", " drive", " square", " terrace",
        " crescent", " way", " place", " grove", "rue ", "avenue ", "boulevard ", "chemin ", "allée ", "impasse ", "quai ", "calle ", "c/", "avenida", "avda", "plaza ", "paseo ",
        "straße", "strasse", "str.", "weg", "platz", "allee", "gasse", "路", "街", "巷", "大道", "弄", "胡同",
    ),
    "person": (
        "name is", "name's", "signed", "yours", "sincerely", "listed as", "booked", "filed under", "on behalf of", "attn", "c/o ", " met ", "meet ", "meeting ", " saw ", "visited ", "hired ", "married ", "thanked ", "invited ", "interviewed ", "rencontr", " vu ", "conoc", " vi a ", "i'm ", "i am ", "signed,", "this is ", "cc ", "talk to ", "ask for ", "registered as", "me llamo", "m'appelle", "heiße ", "heisse ",
        "name ist", "nombre es", "nom est", "sister ", "brother ", "mother ", "father ", "wife ", "husband ", "daughter ", "son ", "boss ", "friend ", "neighbour ", "neighbor ", "colleague ",
        "jefa", "jefe", "dr. ", "dr ", "prof. ", "prof ", "mr ", "mr. ", "mrs ", "mrs. ", "ms ", "ms. ", "frau ", "herr ", "herrn ", "sr. ", "sra. ", "señor ", "señora ", "mme ", "m. ",
        "(my ", "我叫", "名字是", "名字叫", "昨天", "今天", "明天", "刚才", "上周", "一起", "请假", "和", "跟", "落款", "签字", "老师", "联系人", "女士", "先生", "我是",
        "妹妹", "姐姐", "哥哥", "弟弟", "妈妈", "爸爸", "母亲", "父亲", "老婆", "妻子", "丈夫", "老公", "女儿", "儿子", "同事", "朋友", "邻居", "老板", "经理", "上司", "医生",
        "miss ", "mx ", "dra. ", "srta", "señorita", "mlle", "madame", "monsieur", "mademoiselle", "maître", "docteur", "doctor", "doktor", "profes", "don ", "doña ", "uncle ", "aunt ",
        "spoke ", "speak ", "talk", "regards,", "cheers,", "dear ", "hablar con", "hablé con", "habla con", "estimad", "querid", "parler ", "parlé ", "cher ", "chère ", "cordialement", "sprich mit", "gesprochen mit", "frag", "liebe", "geehrte", "grüße", "saludos", "firmado", "signé", "gezeichnet", "atentamente",
        "cousin", "sister", "brother", "mother", "father", "stepm", "stepf", "wife", "husband", "daughter", " my son", "mom ", "mum ", "dad ", "partner", "niece", "nephew", "grandm", "grandp", "grandf", "girlfriend", "boyfriend", "fianc", "boss", "friend", "neighbo", "colleague", "coworker", "co-worker", "manager", "dentist", "therapist", "teacher", "lawyer", "landl", "roommate", "flatmate", "housemate", "supervisor", "my coach", "assistant", "secretary", "tutor", "mentor",
        "sœur", "soeur", "frère", " mère", " père", "maman", "ma femme", "épouse", " mari ", " mari,", "compagn", " fille", " fils", " tante", "oncle", "neveu", "copine", "copain", " chef", "patron", " ami ", " amie", " ami,", "voisin", "collègue", "médecin", "avocat", "propriétaire", "colocataire",
        "herman", "madre", "padre", "mamá", "papá", "mi mujer", "espos", "marido", "novi", " hij", " prim", " tía", " tío", "sobrin", "abuel", " amig", "vecin", "coleg", "compañer", "médic", "abogad", "maestr", "suegr", "cuñad",
        "schwester", "bruder", "mutter", "vater", " mama ", "e mann", "mein mann", "ehefrau", "ehemann", "freund", "tochter", "sohn", "onkel", "neffe", " oma ", " opa ", "nachbar", "kolleg", "arzt", "ärztin", "anwalt", "anwältin", "lehrer", "vermieter", "mitbewohner", "schwieger", "großm", "großv", "schwager", "schwäger",
        " said", " says", " told ", " asked ", " asks ", " wrote", " writes", " called", " calls ", " replie", " mentioned", " suggest", " phoned", "mailed", " texted", " answered", " explained", " promised", " agree", " insist", " warned", " reminded", " knows", " complained", " joked", " laughed", " whispered", " invited", " recommended", " thinks",
        " dit", " écrit", " appel", " répond", " racont", " promis", " expliqu", " proposé", " téléphon", " pense ", " sait ", " dijo", " dice ", " pregunt", " escrib", " llam", " contó", " cuenta", " explicó", " sugirió", " piensa", " sabe", " cree ",
        " sagt", " schrieb", " schreibt", " fragt", " rief", " ruft", " meint", " antwortete", " erzähl", " erklärte", " versprach", " glaubt", " weiß ",
        "表姐", "表妹", "表哥", "表弟", "堂姐", "堂妹", "堂哥", "堂弟", "室友", "同学", "男友", "女友", "阿姨", "叔叔", "舅舅", "姑姑", "奶奶", "爷爷", "外婆", "外公", "房东", "律师", "教授", "护士", "主任", "师傅", "小姐", "博士", "总监", "说", "告诉", "问我", "写道", "回复", "提醒", "答应", "通知", "建议",
    ),
}

# Words of spoken digits, and words for several of them.
_SPOKEN = "zero|oh|one|two|three|four|five|six|seven|eight|nine"
_STREETS = "road|rd|street|st|avenue|ave|lane|ln|close|court|ct|blvd|boulevard|drive|square|terrace|crescent|way|place|grove"

_DOT = r"(?:\.|\s?(?:\[\s?dot\s?\]|\(\s?dot\s?\)|\{\s?dot\s?\})\s?|\s+(?:dot|punto|point|punkt)\s+)"
_LOC = r"A-Za-z0-9À-ɏ_+%\-"
_EMAIL = re.compile(
    rf"(?:mailto:)?(?<![{_LOC}.])[{_LOC}]+(?:(?:{_DOT}|['’])[{_LOC}]+)*?"
    rf"(?:\s?@\s?[\w\-]+(?:{_DOT}[\w\-]+)*{_DOT}[^\W\d_]{{2,}}"
    rf"|\s?(?:\(\s?at\s?\)|\[\s?at\s?\]|\{{\s?at\s?\}})\s?[\w\-]+(?:{_DOT}[\w\-]+)*{_DOT}[^\W\d_]{{2,}}"
    rf"|\s+(?:at|arroba|arobase)\s+[\w\-]+(?:\s+(?:dot|punto|point|punkt)\s+[\w\-]+)+)",
    re.I,
)

_NUM = r"\(?(?<![\w#=.,:-])(?:\+|00)?\(?\d[\d\s().\-/]{5,22}\d(?!\w)(?:,?\s*(?:ext|extension|x|poste|durchwahl)\.?\s*\d{1,5})?"
_PHONE_CUED = re.compile(
    rf"(?:phone|tel|t[eé]l[eé]phone|tel[eé]fono|telefon(?:nummer)?|rufnummer|handynummer|mobilnummer|call|mobile|number\s+is|text\s+me(?:\s+on)?|whatsapp|fax|handy|m[oó]vil|celular|portable|appelez|appelle|llama(?:me|d)?|ll[aá]mame"
    rf"|(?:mon|le)\s+num[eé]ro|mi\s+n[uú]mero|meine\s+nummer|ruf\s+mich(?:\s+an)?|joindre)\b[\s:.]*(?:(?:no|number|me|moi|is|at|on|au|al|est|es|ist|lautet|unter|an)\b\.?|[\s:.])*\s*(?P<n>{_NUM})"
    rf"|(?:手机号?码?|电话号?码?|座机|热线|号码|微信(?:同号|号)?|打)\s*(?:是|为|[:：])?\s*(?P<c>(?:\+?86[\s-]?)?\(?[01]\d[\d\s-]{{6,14}}\d)",
    re.I,
)
_PHONE_SPOKEN = re.compile(rf"\b(?:(?:{_SPOKEN}|double|triple)[\s,\-]+){{6,}}(?:{_SPOKEN})\b", re.I)
# National forms that are telephone numbers without a cue.
_PHONE_FORMS = re.compile(
    r"(?<![\w#=.,:/+-])(?:"
    r"(?:\+\d{1,3}|00[1-9]\d{0,2}(?=[\s.\-(]))[\s.\-]?\(?0?\)?[\s.\-]?\d(?:[\s.\-/()]{0,2}\d){6,12}"
    r"|(?:\+?1[\s.\-])?\(\d{3}\)\s?\d{3}[\s.\-]\d{4}|(?:1[\s.\-])?(?:\d{3}[\s.\-]555[\s.\-]?\d{4}|[2-9]\d{2}(?P<g>[\s.\-])[2-9]\d{2}(?P=g)\d{4})"
    r"|0[1-9]\d{1,2}-\d{3,4}-?\d{4}|0\d(?:[\s.]\d{2}){4}|020\s\d{4}\s\d{4}|1[3-9]\d[\s-]?\d{4}[\s-]?\d{4}"
    r")(?!\w|-\d|\.\d)"
)

_ID_FORMS = re.compile(
    r"(?<![\w-])(?:"
    r"[1-9]\d{5}\s?(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\s?\d{3}[\dXx]"
    r"|\d{3}-\d{2}-\d{4}|\d{8}-[A-Za-z]|[XYZxyz]-?\d{7}-?[A-Za-z]"
    r"|[12]\s\d{2}\s\d{2}\s\d{2}\s\d{3}\s\d{3}(?:\s\d{2})?"
    r")(?!\w|-\d)"
)
_ID_CUED = re.compile(
    r"(?:\bssn|social(?:\s+security)?(?:\s+(?:number|no\.?))?)\b[\s:.#(]*(?:is\b)?[\s:.#(]*\d{3}[-\s.]?\d{2}[-\s.]?\d{4}(?!\d)"
    r"|(?:passport|passeport|pasaporte|reisepass)[\s-]*(?:number|no|nr|n°|nº|nummer)?[\s:.#]*(?:is\b)?\s*[A-Z]{1,3}\s?\d{6,9}\b"
    r"|(?:ausweis(?:nummer|nr)?|personalausweis)[\s:.#]*(?:ist\b)?\s*[A-Z0-9]{2}[A-Z0-9]{6,9}\b"
    r"|\b(?:dni|nie)\b[\s:.#]*(?:es\b)?\s*[A-Z]?\d{7,8}[\s-]?[A-Z]\b"
    r"|(?:id\s+card|resident\s+id|identity\s+(?:card|number)|national\s+id|id\s+no)\b[\s:.#]*(?:number|no\.?|is)?[\s:.#]*[A-Z]{0,2}\d[\d\s]{6,18}[\dX](?!\w)"
    r"|(?:身份证|证件|护照)(?:号码|号)?\s*(?:是|为|[:：])?\s*[A-Z]{0,2}\d[\d\s]{5,18}[\dX](?![\dA-Z])"
    r"|(?:s[eé]curit[eé]\s+sociale|steuer-id|(?:steuer)?identifikationsnummer)[\s:.#]*(?:est|ist)?\s*\d[\d\s]{8,22}\d"
    r"|(?:carte\s+(?:nationale\s+)?d['’]identit[eé]|\bcni)\b[\s:.#]*(?:num[eé]ro|n°|nº|no)?[\s:.#]*(?:est\b)?\s*(?=[A-Z]*\d)[A-Z0-9]{9,12}\b"
    r"|(?:seguridad\s+social|c[eé]dula|\bnif\b)[\s:.#]*(?:n[uú]mero|n\.?[ºo])?[\s:.#]*(?:es\b)?\s*\d[\d\s/.\-]{5,14}\d(?:-?[A-Z])?(?!\w)"
    r"|(?:sozial|renten)versicherungsnummer[\s:.#]*(?:ist\b|lautet\b)?\s*\d{2}\s?\d{6}\s?[A-Z]\s?\d{3}\b"
    r"|national\s+insurance(?:\s+(?:number|no\.?))?[\s:.#]*(?:is\b)?\s*[A-Z]{2}(?:\s?\d{2}){3}\s?[A-D]\b"
    r"|(?:社保卡?|社会保障)(?:号码?|编号)?\s*(?:是|为|[:：])?\s*\d[\d\s]{7,18}[\dX](?![\dA-Z])",
    re.I,
)

_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’]+"
_ADDRESS = re.compile(
    rf"(?i:(?:flat|apt|unit)\s+\d+\w?,\s*)?(?<![\w.])\d{{1,5}}[A-Za-z]?\s+(?:{_CAP}\s+){{1,3}}(?i:{_STREETS})\b(?i:,?\s*(?:apt|flat|unit)\.?\s*\d+\w?)?"
    rf"|(?<![\w.])(?:{_CAP}\s+){{1,3}}(?:{'|'.join(w.capitalize() for w in _STREETS.split('|'))})\.?\s+\d{{1,5}}[A-Za-z]?(?:,\s*(?:first|second|third|fourth|fifth)\s+floor)?(?![\w:])"
    r"|(?i:(?<![\w.])\d{1,5}\s*(?:bis|ter|quater)?,?\s+(?:rue|avenue|av\.|boulevard|bd\.?|place|chemin|allée|impasse|quai|route)\s+(?:de\s+la\s+|de\s+l['’]|du\s+|des\s+|de\s+|d['’])?[\w'’\-]+)"
    r"|(?i:\b(?:calle|avenida|avda\.?|plaza|paseo)\s+|\bc/\s*)(?:[\w'’]+\s+){0,4}[\w'’]+,?\s*(?:n\.?\s?[º°]\s*|núm\.?\s*)?\d{1,4}(?:,\s*\d{1,2}\s?[ºª°]\s?\w?)?(?!\w)"
    r"|(?<!\w)[A-Za-zÄÖÜäöü][\w-]*(?:(?<=\w)(?i:straße|strasse|str\.|weg|platz|allee|gasse))\s+\d{1,4}\s?[a-zA-Z]?(?!\w)(?:,\s*\d{4,5}\s+\w+)?"
    r"|[一-鿿]{1,6}?(?:大道|路|街|巷|胡同)(?:\d+弄)?\d+号(?:\d+[栋幢座])?(?:\d+单元)?(?:\d+[室户])?"
)
_ADDRESS_CUED = re.compile(
    rf"(?:live\s+at|lives\s+at|living\s+at|address(?:\s+is)?:?|ship\s+it\s+to|parcels\s+go\s+to|meet\s+me\s+at|keys\s+are\s+at|deliver\s+to|send\s+it\s+to|moved\s+to)\s+(?P<n>(?:(?:flat|apt|unit)\s+\d+\w?,\s*)?"
    rf"(?:\d{{1,5}}[a-z]?\s+(?:[\w'’]+\s+){{1,3}}(?:{_STREETS})\b|(?:[\w'’]+\s+){{1,3}}(?:{_STREETS})\.?\s+\d{{1,5}}[a-z]?(?!\w)))",
    re.I,
)

# a name: first name and surname, initial and surname, or one of them; after a certain cue case does not matter
_WORD = r"[^\W\d_]{2,}(?:['’\-][^\W\d_]+)*"
_FULL = rf"(?:{_WORD}|[^\W\d_]\.)(?:\s+(?:[^\W\d_]\.\s+)?{_WORD})?"
# Words a name cannot begin or end with.
_NO_NAME = set("the a an and or but not so to of in at on for my our your his her their this that it i we you they he she is was who what when where how again please very".split())

# Words that say who somebody is, and what only people do, in the languages of the data.
_ROLES = {
    "en": "sister|brother|mother|father|mom|mum|dad|wife|husband|partner|daughter|son|cousin|aunt|uncle|niece|nephew|grandmother|grandma|grandfather|grandpa|girlfriend|boyfriend|fianc[ée]e?|boss|friend|neighbou?r|colleague|co-?worker|manager|doctor|dentist"
    "|therapist|teacher|lawyer|landlord|landlady|roommate|flatmate|housemate|supervisor|coach|assistant|secretary|tutor|mentor|stepmother|stepfather|(?:mother|father|sister|brother)-in-law",
    "fr": "sœur|soeur|frère|mère|père|maman|femme|épouse|mari|compagne|compagnon|fille|fils|cousine?|tante|oncle|nièce|neveu|grand-mère|grand-père|copine|copain|chef|cheffe|patronne?|amie?|voisine?|collègue|médecin|dentiste|avocate?|professeure?|propriétaire|colocataire|belle-mère|beau-père|belle-sœur|beau-frère",
    "es": "hermana|hermano|madre|padre|mamá|papá|mujer|esposa|esposo|marido|novia|novio|hija|hijo|prima|primo|tía|tío|sobrina|sobrino|abuela|abuelo|jefa|jefe|amiga|amigo|vecina|vecino|colega|compañera|compañero|médica|médico|doctora?|dentista|abogada|abogado|profesora?|maestra|maestro|suegra|suegro|cuñada|cuñado",
    "de": "schwester|bruder|mutter|vater|mama|papa|frau|mann|ehefrau|ehemann|partnerin|partner|freundin|freund|tochter|sohn|cousine|cousin|tante|onkel|nichte|neffe|neffen|oma|opa|großmutter|großvater|chefin|chef|nachbarin|nachbarn?|kollegin|kollegen?|ärztin|arzt|zahnärztin|zahnarzt|anwältin|anwalt|lehrerin|lehrer|vermieterin|vermieter|mitbewohnerin|mitbewohner|schwiegermutter|schwiegervater|schwägerin|schwager",
}
_MINE = {"en": "my|our|his|her|their|your", "fr": "ma|mon|notre|sa|son|leur|ta|ton|votre", "es": "mi|su|nuestra|nuestro|tu", "de": "(?:mein|unser|sein|ihr|dein)(?:e[mnrs]?)?"}
_SAYS = (
    r"said|says|told|asked|asks|wrote|writes|called|calls|replied|replies|mentioned|suggested|suggests|thinks|phoned|e-?mailed|texted|answered|explained|promised|agreed|agrees|insisted|insists|warned|reminded|knows|complained|joked|laughed|whispered|invited|recommended"
    r"|(?:(?:m['’]|nous\s+|lui\s+)?a\s+)?(?:dit|demandé|écrit|appelé|répondu|raconté|promis|expliqué|proposé|téléphoné)|demande|appelle|raconte|répond|pense|sait"
    r"|(?:(?:me|nos|le|lo)\s+)?(?:ha\s+)?(?:dijo|dice|preguntó|pregunta|escribió|escribe|llamó|llama|respondió|contó|cuenta|explicó|sugirió|piensa|cree|sabe)"
    r"|sagt|sagte|schrieb|schreibt|fragte|fragt|rief|ruft|meinte|meint|antwortete|erzählte|erzählt|erklärte|versprach|glaubt|weiß"
)
_ALONE = r"said|says|told|asked|replied|phoned|texted|whispered|laughed|dijo|preguntó|respondió|a\s+dit|a\s+répondu|sagte|meinte|antwortete"
_HOLDS = r"has|had|will|can|is|was|brought|took|keeps|wants|hat|ist|war|will|kann|kommt|wohnt|est|habite|vient|tiene|es|vive|viene|va|vendrá"
# What a name is followed by when its clause goes on.
_ON = (
    r"and|or|but|please|pls|at|in|on|about|for|to|from|with|when|if|before|after|by|again|here|speaking|calling|writing|today|tomorrow|tonight|now|too|who|because|as|so|since|then"
    r"|y|o|pero|por|en|sobre|para|con|cuando|hoy|mañana|et|ou|mais|à|au|aux|chez|sur|pour|avec|quand|demain|und|oder|aber|bitte|im|am|um|wegen|über|mit|wenn|heute|morgen"
)
_TITLES = (
    r"Dr|Dra|Prof|Mr|Mrs|Ms|Miss|Mx|Frau|Herrn?|Sra?|Srta|Señor(?:a|ita)?|Mme|Mlle|Madame|Monsieur|Mademoiselle|Maître|Docteure?|Doctora?|Doktor|Professor(?:in)?|Profesora?|Don|Doña|Uncle|Aunt"
)
_ASK = (
    r"talk(?:ed|ing)?\s+(?:to|with)|sp(?:eak|oke|oken)\s+(?:to|with)|ask(?:ed)?\s+for|cc|regards,|cheers,|dear|hablar\s+con|hablé\s+con|habla\s+con|pregunt(?:ar|a|e)\s+por|estimad[oa]|querid[oa]|parler\s+(?:à|avec)|parlé\s+(?:à|avec)|demande[rz]|ch[eè]re?|cordialement,"
    r"|sprich\s+mit|gesprochen\s+mit|frag(?:\s+nach|e)|liebe[r]?|sehr\s+geehrte[r]?|grüße,?|saludos,|firmado,?|signé,?|gezeichnet,?|atentamente,"
)
_END = rf"(?=\s*(?:[,.;:!?)\]。，；：！？）]|$)|\s+(?:[-–—]|(?i:{_ON}|{_SAYS}|{_HOLDS})\b))"
_ANY = r"[^\W\d_]{2,}(?:['’\-][^\W\d_]+)*"
_PAIR = rf"(?:{_ANY}|[^\W\d_]\.)\s+(?:[^\W\d_]\.\s+)?{_ANY}"
# names in any case: where the cue and the end of the name leave little else; lower-case ones are checked word by word
_NAMES = re.compile(
    rf"(?i:\b(?:my\s+name\s+is|my\s+name['’]s|me\s+llamo|mi\s+nombre\s+es|je\s+m['’]appelle|mon\s+nom\s+est|ich\s+hei(?:ß|ss)e|mein\s+name\s+ist)\s+(?P<intro>{_FULL}))"
    rf"|(?i:\b(?:signed|yours|sincerely|firmado|signé|gezeichnet)\s*[,:]\s*(?P<sign>{_FULL})){_END}"
    rf"|(?i:\b(?:this\s+is|I\s?['’]?a?m|soy|c['’]est|hier\s+ist)\s+(?P<self>{_PAIR}),?\s+(?:again|here|speaking|calling|writing|from|by\s+the\s+way|btw|de\s+nuevo|encore|nochmal|vom|von)\b)"
    rf"|\bI\s?['’]?a?m\s+(?P<am>{_CAP}\s+{_CAP})(?=[,.;]|\s+and\b|\s+-)"
    rf"|(?i:\b(?:cc|talk\s+(?:to|with)|sp(?:eak|oke)\s+(?:to|with)|ask(?:ed)?\s+for|on\s+behalf\s+of|attn|c/o)[:.]?\s+(?P<two>{_PAIR})){_END}"
    rf"|(?i:\b(?:registered|listed|booked|filed|known)\s+(?:as|under)\s+(?P<entry>{_ANY},\s+{_ANY})){_END}"
    r"|(?:我叫|我的名字是|名字叫|落款[：:]\s*)(?P<o>[一-鿿]{2,4})(?=[，。；,;！!）)\s]|$)"
    r"|找(?P<p>[一-鿿]{2,4})(?:老师|女士|先生|经理|医生|同学)|联系人[是：:]\s*(?P<q>[一-鿿]{2,4}?)(?:老师|女士|先生|经理|医生|[，。；,;]|$)"
    r"|我的?(?:妹妹|姐姐|哥哥|弟弟|妈妈|爸爸|母亲|父亲|老婆|妻子|丈夫|老公|女儿|儿子|同事|朋友|邻居|老板|经理|上司|医生)(?P<s>[一-鿿]{2,4}?)(?=知道|说|有|会|同意|要|在|把|已)"
    r"|(?:^|(?<=[，。；,;！!\s]))(?P<t>[一-鿿]{2,4})[（(]我的?(?:妹妹|姐姐|哥哥|弟弟|妈妈|爸爸|同事|朋友|邻居|老板|经理|上司|医生|老师|室友)[）)]"
    r"|我是(?P<r>[一-鿿]{2,4})(?:老师|女士|先生|经理|医生)"
)
_PART = r"[A-ZÀ-ÖØ-Þ][^\W\d_]+(?:['’\-][^\W\d_]+)*"
_LINK = r"(?:[A-Z]\.\s+|(?:de\s+la|de\s+los|del|de|van\s+der|van|von|du|le|di|da)\s+)"
_WHOLE = rf"(?:[A-Z]\.\s?)*{_PART}(?:\s+{_LINK}?{_PART}){{0,2}}"
_MY_ROLE = "|".join(rf"(?:{_MINE[lang]})\s+(?:{_ROLES[lang]})" for lang in _ROLES)
_NAMES_CUED = re.compile(
    "|".join(rf"(?i:\b(?:{_MINE[lang]})\s+(?:[a-zà-ÿ]+\s+)?(?:{_ROLES[lang]}))(?:\s*,)?\s+(?P<role_{lang}>{_WHOLE})" for lang in _ROLES)
    + rf"|(?P<back>{_WHOLE})\s*[,(]\s*(?i:{'|'.join(rf'(?:{_MINE[lang]})\s+(?:{_ROLES[lang]})' for lang in _ROLES)})\b(?!\s+{_PART})"
    + rf"|(?i:\b(?:{_MY_ROLE}),?\s+(?P<low>{_FULL}),?\s+(?:{_SAYS}|{_HOLDS})\b)"
    + rf"|(?i:\b(?:{_MY_ROLE}),\s+(?P<aside>{_PAIR}),)|(?i:(?P<backlow>{_PAIR})\s*\((?:{_MY_ROLE})\))"
    + rf"|(?i:(?<![\w.])(?P<initial>(?:[^\W\d_]\.\s+)+{_WORD})\s+(?:{_SAYS}|{_HOLDS})\b)|(?<![\w.])(?P<initials>(?:[A-Z]\.\s?)+\s?{_PART})(?=\s*[,;.!?)]|\s+[a-zà-ÿ]|$)"
    + rf"|\b(?i:{_TITLES})\.?\s+(?P<titled>(?:[A-Z]\.\s?)*{_PART}(?:\s+{_LINK}?{_PART})?)"
    + rf"|(?i:(?<!\w)(?:dr|prof|mr|mrs|ms|frau|herrn?|sra|señora?|mme)\.?\s+(?P<titlelow>(?:[^\W\d_]\.\s+)*{_WORD}(?:\s+{_WORD})?)){_END}"
    + rf"|\b(?i:{_ASK})\s+(?:(?i:{_TITLES})\.?\s+)?(?P<asked>{_WHOLE})"
    + rf"|\b(?i:met|meet|meeting|saw|visited|hired|married|thanked|invited|interviewed|rencontré|vu|conocí\s+a|vi\s+a)\s+(?:with\s+)?(?P<met>{_PART}\s+{_LINK}?{_PART})"
    + rf"|(?P<says>{_PART}\s+{_LINK}?{_PART})\s+(?:{_SAYS})\b|(?P<alone>{_PART})\s+(?:{_ALONE})\b"
)
_HAN_ROLE = "妹妹|姐姐|哥哥|弟弟|妈妈|爸爸|母亲|父亲|老婆|妻子|丈夫|老公|女儿|儿子|表姐|表妹|表哥|表弟|堂姐|堂妹|堂哥|堂弟|同事|朋友|邻居|老板|经理|上司|医生|老师|室友|同学|男友|女友|男朋友|女朋友|阿姨|叔叔|舅舅|姑姑|奶奶|爷爷|外婆|外公|房东|律师"
_HAN_TITLE = "老师|女士|先生|经理|医生|教授|律师|阿姨|叔叔|护士|主任|师傅|小姐|同学|博士|总监"
_HAN_SAYS = "说|告诉|问我|打电话|打来|写道|回复|提醒|答应|通知|建议"
_HAN_VERBS = "说打来在是有会把的了和跟去给要想没不很也都告让叫问发写请"
_HAN_NEXT = "请说打来在是有会把的了和跟去给要想没不很也都已告让叫问发写知同提答通建回昨今明刚住带从到对送做"
_HAN_WHEN = "昨天|今天|明天|早上|晚上|刚才|刚刚|上周|下周"
_HAN_SELF = rf"(?:{HAN_DOUBLE}|[{HAN_SURE}])[一-鿿]"
# a second character of the given name, if the clause goes on after it as after a name
_HAN_MORE = rf"(?:(?![{_HAN_VERBS}])[一-鿿](?=[{_HAN_NEXT}，。；,;！!？?）)\s]|$))?"
_HAN_NAMES = re.compile(
    rf"(?:{_HAN_ROLE})[，：:、]?(?P<s>{_HAN_SELF}{_HAN_MORE})(?=[{_HAN_NEXT}，。；,;！!？?）)\s]|$)"
    rf"|(?:^|[^一-鿿]|{_HAN_WHEN}|[和跟找给问请叫让由对向从与是见])(?P<t>(?:{HAN_DOUBLE}|[{HAN_SURE}])[一-鿿]{{0,2}}?)(?={_HAN_TITLE})"
    rf"|(?:^|[^一-鿿]|{_HAN_WHEN}|听|[和跟找给问请叫])(?P<u>{_HAN_SELF}{_HAN_MORE})(?={_HAN_SAYS})"
    rf"|(?:^|[^一-鿿]|[和跟找给问请叫让])(?P<v>[小老](?:[{HAN_SURE}]))(?={_HAN_SAYS})"
    rf"|(?:^|[^一-鿿]|{_HAN_WHEN}|[和跟找给问让])(?P<w>{_HAN_SELF}(?![{_HAN_VERBS}])[一-鿿])(?={_HAN_WHEN}|一起|请假|住在|来了|去了)"
)
_HAN_NOT = set("高兴 周末 方便 安全 成功 常常 经常 平时 金额 许多 程序 程度 黄金 黄色 何时 任何 严重 孔子 谢谢 张罗 于是 任课 罗列 唐突 江湖 白天 马上 温度 叶子 段落 应该 卢布 周围 周日 周一 周二 周三 周四 周五 周六 孟子 陈述 陈列 许可 曹操 莫非 莫名 顾客 顾问 余额 严格 范围 史诗 施工 章节 方案".split())
# Words a name does not contain, and words beside a name that make it something else.
_NOT_NAMES = set(
    "the a an and or but not so to of in at on for from with by my our your his her their this that these those it its i we you they he she who what when where why how if then there here no yes ok please very again still maybe also only just never always every some any all none both each"
    " nobody somebody someone everybody everyone anybody anyone people others guests doctors users user assistant system team support nothing everything something them him us me staff management customers reviewers today tomorrow yesterday tonight later first second next last new old good bad"
    " monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december english german french spanish chinese"
    " montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz mai juni juli oktober dezember der die das den dem des ein eine einen einem einer und oder aber nicht ich du er sie es wir ihr man jemand niemand alle heute morgen gestern kaffee"
    " le la les un une des et ou mais pas je tu il elle on nous vous ils elles qui que el los las una unos y o pero no yo él ella usted ustedes nosotros ellos quien alguien nadie todos todo hoy ayer mañana lundi mardi mercredi jeudi vendredi samedi dimanche lunes martes miércoles jueves viernes sábado domingo"
    " customer customers colleagues siri alexa google chatgpt claude copilot twitter reddit wikipedia slack github jira amazon apple microsoft sir madam all".split()
)
_OFTEN_ELSE = re.compile(r"(?i:demand|frag|liebe|cher|chère|querid)")  # cues that often stand before something else
_THING_BEFORE = re.compile(r"(?i:(?<!\w)(?:project|projekt|proyecto|projet|operation|code\s?name|branch|cluster|server|release|san|santa|santo|sankt|saint|sainte|st\.?|lake|mount|port|fort|hotel|café|hurricane|place|rue|calle|avenue|plaza|university|universidad|team|app|tool|library|package))\s+$")
_THING_AFTER = re.compile(r"(?i:['’]?\s+(?:street|road|avenue|lane|square|project|server|cluster|county|island|university|airport|hospital|beach|bay|branch|release|library|framework|api|app)\b)")
_KNOWN = re.compile(rf"(?:(?<![\w@/.#_\-])|(?<=\b[A-Z]\.))({_PART})(?![\w@/_]|\.\w)")
_INITIAL_BEFORE = re.compile(r"(?<![\w@/.#_\-])[A-Z]\.\s?$")
_PART_BEFORE = re.compile(rf"(?<![\w@/.#_\-])({_PART})\s+$")
_KNOWN_LOW = re.compile(r"(?<![\w@/.#_\-])([^\W\d_]{2,})\s+([^\W\d_]{3,})(?![\w@/_]|\.\w)")
_NEXT_PART = re.compile(rf"\s+{_LINK}?({_PART})(?![\w@/_]|\.\w)")


_LETTER = re.compile(r"[A-Za-zÀ-ɏ]{2}")


def _trimmed(text: str, a: int, b: int) -> tuple[int, int] | None:
    """A span of words without those at either end that no name has."""
    words = [(m.start() + a, m.end() + a) for m in re.finditer(r"\S+", text[a:b])]
    while words and text[slice(*words[0])].strip("'’,").lower() in _NOT_NAMES:
        words.pop(0)
    while words and text[slice(*words[-1])].strip("'’,").lower() in _NOT_NAMES:
        words.pop()
    if not words or any(text[slice(*w)].strip("'’,").lower() in _NOT_NAMES for w in words):
        return None
    return words[0][0], words[-1][1]


_IS_TITLE = re.compile(rf"(?i:{_TITLES})\.?")


def _cued(text: str, m: re.Match) -> tuple[int, int] | None:
    group = m.lastgroup
    a, b = m.span(group)
    words = [w.lower().strip(".,") for w in text[a:b].split() if len(w) > 2 or w[-1] != "."]  # initials aside
    known = any(w in GIVEN or w in SHARED or w in SURNAMES for w in words)
    if group in ("low", "aside", "backlow", "initial", "titlelow"):
        if any(w in _NOT_NAMES or w in COMMON for w in words):
            return None
        before = text[m.start() : a].split()
        if text[a].islower() and before and before[-1][0].isupper() and group == "low":
            return None  # where nouns are capitalised, names are
        return (a, b) if known or group != "low" or not any(w.endswith("ly") for w in words) else None
    if not known:
        after = re.match(rf"\s*(?:[,.;:!?)]|$)|\s+(?:{_SAYS}|{_HOLDS})\b", text[b : b + 24])
        if not after and group != "back" and (group == "role_de" or text[:a].rstrip()[-1:] == ","):  # every noun is capitalised; a new clause
            return None
        if text[a:b].isupper() and re.search(r"\w[A-ZÄÖÜ]", text[m.start() : a]):
            return None
        if group == "asked" and _OFTEN_ELSE.match(m.group()):
            return None
        if text[a:b].isupper() and text[max(0, a - 12) : a].isupper() or text[b : b + 12].isupper() and text[a:b].isupper():
            return None  # capitals say nothing in a text of capitals
    if _THING_BEFORE.search(text, max(0, a - 16), a) or _THING_AFTER.match(text, b):
        return None
    return _trimmed(text, a, b)


def _known(text: str, spots: list[int]) -> Iterator[tuple[int, int]]:
    """Names that the lists tell, at the places where a listed name stands: with what belongs to it."""
    last = 0
    for at in spots:
        m = _KNOWN.match(text, at)
        if not m or at < last:
            continue
        word = m.group(1).lower()
        size = 2 if word.endswith(("'s", "’s")) else 0  # a genitive
        word = word[: len(word) - size]
        given, shared = word in GIVEN or (("-" in word) and word.split("-")[0] in GIVEN), word in SHARED
        if given or shared or word in ONLY_SURNAMES:
            a, b = _initials(text, m.start()), m.end() - size
            n = _NEXT_PART.match(text, b)
            if n and (n.group(1).lower() in _NOT_NAMES or text[a:b].isupper() != n.group(1).isupper()):
                n = None
            if word in ONLY_SURNAMES and not given and not shared:
                before = _PART_BEFORE.search(text, last, a)
                if before and before.group(1).lower() not in _NOT_NAMES and not text[a:b].isupper():
                    a = before.start(1)
            elif shared:
                b = n.end() if n and n.group(1).lower() in SURNAMES else -1
            elif n and (n.group(1).lower() in SURNAMES or not text[a:b].isupper()):
                b = n.end()
                if (f := _NEXT_PART.match(text, b)) and f.group(1).lower() in SURNAMES:
                    b = f.end()
            if b > 0 and not _THING_BEFORE.search(text, max(0, a - 16), a) and not _THING_AFTER.match(text, b):
                last = b
                yield a, b
    if spots and text.islower():
        for at in spots:
            m = _KNOWN_LOW.match(text, at)
            if m and m.group(1) in GIVEN and m.group(2) in SURNAMES:
                yield m.span()


def _initials(text: str, a: int) -> int:
    """Where a name begins if initials stand before its part at ``a``."""
    while (m := _INITIAL_BEFORE.search(text, max(0, a - 4), a)) is not None:
        a = m.start()
    return a


_GAP = re.compile(r"\W+|$")


def _names(text: str, windows: list[tuple[int, int]], spots: list[int]) -> Iterator[tuple[int, int]]:
    """Names after or before a cue, then names of the lists."""
    for a, b in windows:
        part = text[a:b]
        letters = _LETTER.search(part)
        for m in _NAMES.finditer(part):
            if span := _person(m):
                yield a + span[0], a + span[1]
        m = _NAMES_CUED.search(part) if letters else None
        while m is not None:
            span = _cued(part, m)
            if span:
                yield a + span[0], a + span[1]
            # what was no name there may be the cue of the next one
            m = _NAMES_CUED.search(part, m.end() if span else _GAP.search(part, m.start() + 1).end())
        for m in () if part.isascii() else _HAN_NAMES.finditer(part):
            if m.group(m.lastgroup)[:2] not in _HAN_NOT:
                x, y = m.span(m.lastgroup)
                yield a + x, a + y
    yield from _known(text, spots)


@cache
def automaton() -> ahocorasick.Automaton:
    """All cues of all kinds, pairs of digits and known names in one automaton; a cue may belong to several kinds."""
    kinds: dict[str, list[str]] = defaultdict(list)
    for kind, cues in ANCHORS.items():
        for c in cues:
            kinds[c].append(kind)
    for n in range(100):
        kinds[f"{n:02}"] += ["phone", "id_number"]
    for word in _SPOKEN.split("|"):
        for after in " ,-":
            kinds[word + after] += ["phone", "spoken"]
    for name in GIVEN | SHARED | ONLY_SURNAMES:
        kinds[name].append("name")
    out = ahocorasick.Automaton()
    for cue, of in kinds.items():
        out.add_word(cue, (len(cue), tuple(of)))
    out.make_automaton()
    return out


#: Full-width marks that end Chinese clauses: they stay as they are.
_CHINESE_MARKS = "，。；：！？"


@cache
def _odd() -> np.ndarray:
    """By code point: whether a text with it is to be parsed in canonical form."""
    kind = transducer().kind != 0
    kind[[ord(c) for c in _CHINESE_MARKS]] = False
    return kind


def readable(text: str) -> tuple[str, list[int] | None]:
    """(text to parse, source position of each of its characters and of its end; None: the same)."""
    if text.isascii() or not _odd()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any():
        return text, None
    out: list[str] = []
    at: list[int] = []
    last = 0
    for a, b, new in transducer().edits(text):
        if text[a:b] in _CHINESE_MARKS:
            continue
        out += (text[last:a], new)
        at.extend(range(last, a))
        at.extend([a] * len(new))
        last = b
    out.append(text[last:])
    at.extend(range(last, len(text)))
    at.append(len(text))
    return "".join(out), at


def _person(m: re.Match) -> tuple[int, int] | None:
    group = m.lastgroup
    a, b = m.span(group)
    if group in "opqrst":
        return (a, b)
    words = m.group(group).replace(",", " ").lower().split()
    if group in ("intro", "sign", "am", "entry"):
        return None if words[0] in _NO_NAME or words[-1] in _NO_NAME else (a, b)
    if _IS_TITLE.fullmatch(words[0]):
        return None  # the name after a title is found by itself
    return None if any(w.strip(".") in COMMON or w in _NOT_NAMES for w in words) else (a, b)


_VALUE = re.compile(r"(?<![A-Za-z])[A-Za-z]{2}\s?(?:\d{2}\s?){3}[A-Da-d]$|(?<![A-Za-z])(?:[A-Za-z]{1,3}(?=\s?\d{5}))?\d[\w\s.\-]*$|(?<![A-Za-z])[A-Za-z]{1,3}\d[\w\s.\-]*$")
_PLACED = re.compile(r"^[一-鿿]*?(?:住在|寄到|送到|搬到|寄给|地址|到|在)(?=[一-鿿]{2,}?(?:大道|路|街|巷|胡同))")


def _bounds(kind: str, m: re.Match) -> tuple[int, int] | None:
    """Where the information itself stands in a parser's match: without its cue."""
    a, b = m.span()
    if kind == "email":
        return (a + 7, b) if m.group()[:7].lower() == "mailto:" else (a, b)
    if kind == "id_number" and (v := _VALUE.search(m.group())):
        return a + v.start(), b
    if kind == "address":
        if m.re.groups and m.group("n"):
            return m.span("n")
        if v := _PLACED.match(m.group()):
            return a + v.end(), b
    return a, b


# Digits of a telephone number after its country code, by code (fewest, most), and of all others.
_PHONE_LENGTHS = {"1": (10, 10), "33": (9, 9), "34": (9, 9), "44": (9, 10), "49": (6, 12), "86": (10, 11), "39": (8, 11), "41": (9, 9), "43": (6, 13), "": (7, 12)}
# Weights and check characters of Chinese identity numbers; check letters of Spanish ones; provinces.
_CN_WEIGHTS, _CN_CHECK = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2), "10X98765432"
_ES_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
_CN_PROVINCES = frozenset("11 12 13 14 15 21 22 23 31 32 33 34 35 36 37 41 42 43 44 45 46 50 51 52 53 54 61 62 63 64 65 71 81 82 91".split())


def valid_id(number: str) -> bool:
    """Whether a number that nothing announces is an identity number: by its check digit, check letter or range."""
    n = re.sub(r"[\s-]", "", number).upper()
    if re.fullmatch(r"\d{17}[\dX]", n):
        return n[:2] in _CN_PROVINCES and _CN_CHECK[sum(int(d) * w for d, w in zip(n, _CN_WEIGHTS, strict=False)) % 11] == n[-1]
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", number):
        return n[:3] not in ("000", "666") and n[0] != "9" and n[3:5] != "00" and n[5:] != "0000"
    if re.fullmatch(r"[XYZ\d]\d{7}[A-Z]", n):
        return _ES_LETTERS[int(n[:-1].translate(str.maketrans("XYZ", "012"))) % 23] == n[-1]
    if re.fullmatch(r"[12]\d{12}(?:\d{2})?", n):
        month = int(n[3:5])
        return (1 <= month <= 12 or 20 <= month <= 42 or 50 <= month) and (len(n) == 13 or 97 - int(n[:13]) % 97 == int(n[13:]))
    return False


def valid_phone(number: str) -> bool:
    """Whether a number that nothing announces has a telephone number's length, by its country code."""
    international = re.match(r"\s*(?:\+|00)", number)
    digits = re.sub(r"\D", "", number.replace("(0)", ""))
    if not international:
        return 9 <= len(digits) <= 13
    digits = digits.removeprefix("00")
    code = next((c for c in _PHONE_LENGTHS if c and digits.startswith(c)), "")
    low, high = _PHONE_LENGTHS[code]
    size = len(digits) - len(code)
    return low <= size <= high or (size == high + 1 and digits[len(code)] == "0") or (not code and low <= size <= high + 3)


def _phones(part: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE_CUED.finditer(part):
        group = "n" if m.group("n") else "c"
        digits = sum(c.isdigit() for c in re.split(r"(?i)ext|x", m.group(group))[0])
        if 7 <= digits <= 15:
            yield m.span(group)
    for m in _PHONE_FORMS.finditer(part):
        if valid_phone(m.group()):
            yield m.span()
    for m in _PHONE_SPOKEN.finditer(part):
        yield m.span()


def _ids(part: str) -> Iterator[tuple[int, int]]:
    for m in _ID_CUED.finditer(part):
        yield _bounds("id_number", m)
    for m in _ID_FORMS.finditer(part):
        if valid_id(m.group()):
            yield m.span()


_BLANK_LINE = re.compile(r"\n[^\S\n]*\n\s*")


def _paragraphs(text: str) -> list[int]:
    """Where the paragraphs of a text begin, and its end."""
    return [0, *(m.end() for m in _BLANK_LINE.finditer(text)), len(text)]


#: Where no name goes on: ends of sentences and clauses, but not the full stop of an initial or a title.
_CLAUSE_END = re.compile(r"[;!?。！？；\n]|(?<=[^\W\d_A-Z]{3})(?<!(?i:prof))(?<!(?i:srta))(?<!(?i:mlle))(?<!(?i:attn))\.(?=\s)")


def _clauses(text: str) -> list[int]:
    """Where the clauses of a text begin, and its end."""
    return [0, *(m.end() for m in _CLAUSE_END.finditer(text)), len(text)]


def _windows(spots: list[int], edges: list[int]) -> Iterator[tuple[int, int]]:
    """The paragraphs or clauses in which an anchor stands."""
    done = -1
    for at in spots:
        if at >= done:
            k = bisect_left(edges, at + 1) - 1
            done = edges[k + 1]
            yield edges[k], done


class _Spans:
    """What is found, without overlaps: what is taken is not taken again."""

    def __init__(self) -> None:
        self.taken: list[tuple[int, int, str]] = []

    def add(self, kind: str, a: int, b: int) -> None:
        k = bisect_left(self.taken, (a,))
        if (k == 0 or self.taken[k - 1][1] <= a) and (k == len(self.taken) or self.taken[k][0] >= b):
            insort(self.taken, (a, b, kind))


_PERSON, _ADDRESS_ONLY = ("person",), ("address",)
#: What any number of a person has: six digits near each other.
_DIGITS = re.compile(r"\d(?:[A-Za-z\s().\-/]{0,3}\d){5}")


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all personal information of a text, in its own positions, without overlaps."""
    if not text:
        return []
    plain, at = readable(text)
    spots: dict[str, list[int]] = defaultdict(list)
    lower = plain.lower()
    if len(lower) != len(plain):
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in plain)
    for end, (size, kinds) in automaton().iter(lower):
        a = end + 1 - size
        if kinds == _PERSON and a and lower[a].isalpha() and lower[a - 1].isalpha() and lower[a] < "一":
            continue  # the end of another word
        if kinds == _ADDRESS_ONLY and "a" <= lower[end] <= "z" and lower[end + 1 : end + 2].isalpha():
            continue  # the beginning of another word
        for kind in kinds:
            spots[kind].append(a)
    if not ("phone" in spots or "id_number" in spots) or not (_DIGITS.search(plain) or "spoken" in spots):
        spots.pop("phone", None), spots.pop("id_number", None)
    edges = _paragraphs(plain)
    found = _Spans()
    # papers before numbers, numbers before streets and names
    for kind, parse in _PARSERS.items():
        for a, b in _windows(sorted(spots[kind]), edges) if kind in spots else ():
            part = plain[a:b]
            for x, y in parse(part):
                found.add(kind, a + x, a + y)
    if "person" in spots or "name" in spots:
        for a, b in _names(plain, list(_windows(sorted(spots["person"]), _clauses(plain))) if "person" in spots else [], sorted(spots["name"])):
            found.add("person", a, b)
    if at is None:
        return found.taken
    return [(at[x], at[y - 1] + 1 if at[y] <= at[y - 1] else at[y], k) for x, y, k in found.taken]


def _matches(kind: str, *patterns: re.Pattern) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda part: (_bounds(kind, m) for p in patterns for m in p.finditer(part))


_PARSERS = {"email": _matches("email", _EMAIL), "id_number": _ids, "phone": _phones, "address": _matches("address", _ADDRESS, _ADDRESS_CUED)}


def redact(text: str | None, found: list[tuple[int, int, str]] | None = None) -> str | None:
    """The text with a typed placeholder, e.g. ``[EMAIL]``, in place of everything found."""
    if not text:
        return text
    out, last = [], 0
    for a, b, kind in find(text) if found is None else found:
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join(out) + text[last:]


def scan_pii(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, found array<struct<start, end, kind>>, redacted string.

    One row per input row: repeated rows stay, null texts give null, empty
    texts give an empty list. Positions count characters of the stored text.
    Nothing is shuffled; of very long texts only paragraphs with anchors are parsed.
    """
    rows = df.select(*keep, F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            found = [None if t is None else find(t) for t in texts]
            lists = pa.array([None if f is None else [{"start": a, "end": b, "kind": k} for a, b, k in f] for f in found], kind)
            new = pa.array([t if not f else redact(t, f) for t, f in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lists, new], [*keep, "found", "redacted"])

    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", found array<struct<start: int, end: int, kind: string>>, redacted string"
    return rows.mapInArrow(run, schema)


def kinds_found(scanned: DataFrame, keep: list[str]) -> DataFrame:
    """One row per ``keep`` values and kind found in the row."""
    return scanned.select(*keep, F.explode(F.array_distinct("found.kind")).alias("kind")).distinct()

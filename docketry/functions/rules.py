"""Wording that the filters and validators look for.

Fixed values: the patterns below have to be these for right results. They are written for Python's ``re`` without regard to case,
unless a comment says otherwise; ``java`` makes a pattern for Spark's functions of one.
"""

from __future__ import annotations

# sections
OPERATIVE = r"П\s*О\s*С\s*Т\s*А\s*Н\s*О\s*В\s*И\s*Л\s*[:.]?"
OPERATIVE_ORIGINAL = r"п\s*о\s*с\s*т\s*а\s*н\s*о\s*в\s*и\s*л(?:а)?\s*:?"
OPERATIVE_APPEAL = r"(?:Р\s*Е\s*Ш\s*И\s*Л(?:А)?|П\s*О\s*С\s*Т\s*А\s*Н\s*О\s*В\s*И\s*Л(?:А)?|О\s*П\s*Р\s*Е\s*Д\s*Е\s*Л\s*И\s*Л(?:А)?)\s*:??"
ESTABLISHED = r"У\s*С\s*Т\s*А\s*Н\s*О\s*В\s*И\s*Л(?:А)?\s*:??"

# irrelevant sentences: parts of the lower-cased text; signs that aren't part of a word (with regard to case); nothing but numbers
IRRELEVANT_PARTS = ("реквизит", "ре...изит", "квитанци", "судья")
IRRELEVANT_SIGNS = r"(?<!\w)(?:БИК|ИНН|УИН|КБК|ОКТМО|л/с|р/с)(?!\w)"
IRRELEVANT_NUMBERS = r"(?:\d+\s*)+[.!?]?"

# reasons to drop a sentence of the operative section
SIGNATURE = (
    r"(?:<[^>]+>\s*)*(?:(?:мировой|федеральный)\s+)?(?:судья|председательствующ(?:ий|ая))"
    r"(?:\s*[:—/-])?(?:\s*(?:\([^)]*\)|/[^/]*/|[А-ЯЁA-Z][\w.-]*:?)){0,12}\s*[.!]?"
)
SIGNATURE_CONTINUED = r"(?:городского|районного|областного|краевого|верховного)\s+суда\s*:\s*(?:[А-ЯЁ]\s*\.\s*){1,3}[А-ЯЁ][а-яё-]+\s*[.!]?"
MASKED = r"(?:\s|<[^>]+>|\[[^]]+]|\([^)]*(?:данн|изъят|скрыт)[^)]*\)|[-–—.,;:№])+"
NUMERIC = r"(?:[\d\s.,;:/№-]+)[.!?]?"
BOILERPLATE = r"(?:административный\s+штраф|подлинный\s+документ\s+подшит|копия\s+верна)\s*[.!]?"
PAYMENT_TITLE = r"^(?:наименование|назначение)\s+платежа\b"
BANK_SIGN = (
    r"(?<!\w)(?:бик|инн|кпп|уин|кбк|октмо|огрн|л/с|р/с|кор\.?\s*сч(?:ет)?|"
    r"расч[её]тн(?:ый|ого)\s+сч[её]т|реквизит\w*|банковск\w*\s+реквизит|банк\s+получателя|"
    r"получатель\s+платежа|уфк)(?!\w)"
)
BANK_START = (
    r"^(?:реквизит|банковск\w*\s+реквизит|наименование\s+(?:платежа|получателя)|"
    r"взыскатель|получатель\b|банк\b|отделени\w*.*\bбанк|номер\s+сч[её]та|"
    r"№\s*сч[её]та|корр?\.?/?сч(?:[её]т)?|р/сч|окато\b|"
    r"казначейск\w*\s+сч[её]т|единый\s+казначейск\w*\s+сч[её]т|"
    r"код\s+бюджетн\w*\s+кл[а-яё]*сификац|идентификатор\b|(?:в\s+)?гу\s+банка\s+россии\b|"
    r"наименование\s+банка|банк\s+получател|уфк\b)"
)
BANK_CONTINUED = (
    r"(?:\([^)]*\b(?:омвд|умвд|мвд|уфк|казначейств|банк|получател)\w*\b[^)]*\)|"
    r"(?:омвд|умвд|мвд|уфк|гу\s+(?:мвд|банка))\b[^.!?]*)\s*[.,;]?"
)
RECEIPT = r"\bквитанци\w*\b"
SUBSTANTIVE = (
    r"\b(?:признать|виновн|назначить|наказани|постановлени\w*\s+(?:может\s+быть\s+)?"
    r"обжал|обжалован|жалоб|(?:не\s+позднее|в\s+течени[еи]|на\s+следующ\w+\s+день)|"
    r"срок\w*\s+не\s+позднее|ответственност|выдворени|рассроч|"
    r"отсроч|вступлени\w*\s+в\s+законную\s+силу|контрол\w*\s+за\s+исполнени)\b"
)

# originals
PROCEEDING = r"(?:дел[оауе]|материал\w*)\s+об\s+административн\w*\s+правонарушен"
REVIEW_OPENING = r"рассмотрев.{0,1000}?(?:жалоб[уы]|протест).{0,600}?(?:на\s+постановлен|постановлени[ея].{0,100}?по\s+делу)"
REVIEW_OUTCOME = (
    r"(?:постановлени[ея]|решени[ея]).{0,500}?(?:оставить\s+без\s+изменения|отменить|изменить)|"
    r"жалоб[уы].{0,300}?оставить\s+без\s+удовлетворения"
)
ADJUDICATION = r"признать.{0,500}?виновн|привлечь.{0,500}?к\s+административн\w*\s+ответственност"
PENALTY = (
    r"назначить.{0,240}(?:административн\w*\s+)?наказан|подвергнуть.{0,240}(?:административн\w*\s+)?наказан|"
    r"административн\w*\s+(?:штраф|арест|выдворен|приостановлен)|"
    r"(?:штраф|арест|выдворен|предупрежден|обязательн\w*\s+работ|дисквалификац|конфискац)"
)
APPEAL_NOTICE = r"постановлени[ея].{0,180}(?:может\s+быть|вправе).{0,80}обжал"
JUDGE_SIGNED = r"судья\s+[А-ЯЁA-Z]"
CODE_NEAR = r"КоАП\s*(?:РФ|России)?|Кодекс[а-я\s]{0,100}об\s+административных\s+правонарушениях"

# appeals
CHAPTER_30 = (
    r"(?:глав\w*\s*30\s*(?:КоАП|Кодекс\w*.{0,80}?административн)|"
    r"(?:ст\.?(?:\s*ст\.?)?|стать\w*)\s*30\s*[.,]\s*[1-9]"
    r"(?:\s*[-–,]\s*(?:30\s*[.,]\s*)?[1-9])?\s*"
    r"(?:КоАП|Кодекс\w*\s+Российской\s+Федерации\s+об\s+административных\s+правонарушениях))"
)
CHALLENGE = r"жалоб\w*.{0,700}?\bна\s+(?:постановлени|решени|определени)\w*"
PRIOR_REVIEW = r"\bна\s+(?:решени|определени)\w*"
COMPLAINT = r"рассмотр\w*.{0,1400}?(?:по\s+)?жалоб\w*.{0,800}?на\s+(?:вынесенн\w*.{0,180}?)?постановлени\w*"
CHALLENGED = (
    r"постановлени(?:ем|е|я)\s+.{0,1200}?(?:признан\w*\s+виновн\w*|"
    r"привлечен\w*\s+к\s+административной\s+ответственности|назначен\w*\s+административн\w*\s+наказан\w*)"
)
OPERATIVE_CITATION = (
    r"(?<!\w)ст(?:атья|атье|атьи|атью|атьёй|атьей)?\.?\s*(\d+\s*[.,]\s*\d+(?:\s*[.,]\s*\d+)?)\s*"
    r"(?:КоАП|Кодекс\w*\s+Российской\s+Федерации\s+об\s+административных)"
)
PROCEDURAL = ("24.", "25.", "26.", "27.", "28.", "29.", "30.", "31.", "32.")
FACTUAL_CHARGE = r"факт\s+совершения.{0,100}?правонарушения\s*,?\s*предусмотренного.{0,100}?ст(?:\.|ать\w*)?\s*(\d+\s*[.,]\s*\d+)"
DISPOSITIONS = (
    ("revoked_and_sent_jurisdiction", r"постановлени\w*.{0,700}?отменить.{0,700}?(?:направить|передать).{0,300}?(?:подведомственност|подсудност|компетенц)"),
    ("revoked_and_remanded", r"постановлени\w*.{0,700}?отменить.{0,700}?(?:дело|материал\w*).{0,300}?(?:возвратить|направить).{0,250}?новое рассмотрение"),
    ("revoked_and_closed", r"постановлени\w*.{0,700}?отменить.{0,700}?производств\w*.{0,250}?прекратить"),
    ("changed", r"постановлени\w*.{0,700}?(?<!без )изменить(?:\s|[.,:])"),
    ("upheld_denied", r"постановлени\w*.{0,900}?оставить\s+без\s+изменения.{0,500}?жалоб\w*.{0,200}?без\s+удовлетворения"),
)

# exclusions (the spacing marks with regard to case)
FEDERAL = r"федеральн[а-яё]*\s+закон(?:а|ом|у|е|ы|ов|ам|ами|ах)?\b|(?<!\w)Ф\s*З(?!\w)"
FEDERAL_ARTICLE = r"\bст(?:\.|ать[а-яё]*)\s*\d+(?:\.\d+)*\s*(?:Ф\s*З\b|Федеральн[а-яё]*\s+закон)"
FEDERAL_ASIDE = r"(?:специальн[а-яё]*\s+учрежден|срок[а-яё]*\s+содержани|в\s+случаях,?\s+установленных\s+федеральным\s+законом)"
CODE_NAMED = r"КоАП|КРФ\s*об\s*АП|Кодекс[а-яё]*\s+(?:Российской\s+Федерации|РФ)\s+об\s+административных"
ARTICLE_NAMED = r"\bст(?:\.|ать[а-яё]*)\s*(\d+(?:\.\d+)+)"
PART_NAMED = r"(?:ч\.|част[а-яё]*)\s*(\d+(?:\.\d+)*)"
GUILT = r"\bвиновн[а-яё]*\b"
ACTION = r"\b(?:назначить|назначив|подвергнуть|подвергнув|наложить|наказать)\b"
ADVICE = r"^\s*(?:Разъясн|Согласно|В соответствии|В силу|За\s|В случае|При\s|Сумм[ау]\s)"
EXPULSION = r"выдвор"
NO_EXPULSION = r"без[^.;\n]{0,100}выдвор|выдвор[^.;\n]{0,150}не\s+(?:применять|назначать)|не\s+(?:применять|назначать)[^.;\n]{0,100}выдвор"
EXPEL = r"\bвыдворить\b"
WITH_EXPULSION = r"\bс\s+(?:[а-яё()]+\s+){0,8}выдворени[ея]м|\bи\s+административного\s+выдворения"
EXPULSION_CARRIED = r"выдворение[^.;\n]{0,150}(?:назначить|осуществить|произвести)"
DEPARTURE = r"обязан[а-яё]*\s+(?:самостоятельно\s+)?выехать|\bобязать\b[\s\S]{0,1200}\bвыехать\b"
ENTREPRENEUR = r"\bИП\b|индивидуальн[а-яё]*\s+предпринимател[а-яё]*"
OF_ANOTHER = r"(?:\b(?:у|к|от)\s*|работа[а-яё]*[^,;]{0,75}|представител[а-яё]*\s*)"
OPENED = r"\bу\s*с\s*т\s*а\s*н\s*о\s*в\s*и\s*л(?:\s*а)?\b"
CALLED_TO_ACCOUNT = r"^\s*привлечь"
OF_THE_ACCUSED = r"в\s+отношении\s*:?\s*(?:ФИО\d+[^\n]{0,160})?$|о\s+привлечении[^\n]{0,180}ответственности[^\n]{0,100}$"
SEVERAL_PLURAL = r"совершении\s+(?:административных\s+)?правонарушени(?:ях|й)\b"
SEVERAL_PARTS = r"част(?:ями|ей)\s+\d+\s*(?:,|и)\s*\d+"
SEVERAL_MENTIONED = (
    r"объедин[а-яё]*[^\n]{0,200}(?:производств|дел[ао])|"
    r"(?<![\w.])(?:два|двух|три|тр[её]х|нескольк[а-яё]*|[2-9]\d*)\s+"
    r"(?:самостоятельных\s+|административных\s+)?(?:эпизод[а-яё]*|правонарушени[йя])|"
    r"по каждому (?:эпизод|правонаруш)|по\s+\d+\s+эпизод"
)
SPACING = (
    r"емунаказание|ейнаказание|рождениявиновн[а-яё]*|рублейс\b|размере\d+|"
    r"год[а-яё]*рождения|виновн[а-яё]*в\s+совершении|предусмотренногоч|"
    r"[а-яё]{3,}[А-ЯЁ][а-яё]{3,}|рублейбез\b"
)

# remarks
REMARK = r"^Примечани(?P<form>е|я)\s*[.:]\s*(?P<body>.*)$"
REMARK_NUMBER = r"^(\d+(?:\.\d+)*)\.\s+"
REMARK_ARTICLE = r"^Статья\s+(\d+(?:\.\d+)*(?:\s+\d+)*)\.(?:\s|$)"
EDITORIAL = ("Комментарий", "Информация о версии", "Информация об изменениях", "Подзаголовок для информации об изменениях")
REPEALED = r"\bутратил[оиа]\s+силу|\bутратили\s+силу"
SCOPE_CODE = r"(?:для целей|в)\s+настоящ(?:его|ем)\s+Кодекс"
SCOPE_CHAPTER = r"настоящ(?:ей|ую)\s+глав"
SCOPE_PARTS = r"част(?:ь|и|ью|ей|ями|ях)\s+(\d+(?:\.\d+)*(?:\s*(?:[-–—]|,|или|и)\s*\d+(?:\.\d+)*)*)\s+настоящей\s+стать[а-я]+"
SCOPE_ARTICLE = r"настоящ(?:ей|ую|ая)\s+стать"


def java(pattern: str, whole: bool = False, cased: bool = False) -> str:
    """The pattern for Java: Unicode classes, without regard to case unless ``cased``; of a ``whole`` text if asked."""
    pattern = pattern.replace(r"[^]]+]", r"[^\]]+\]")
    return ("(?U)" if cased else "(?iuU)") + (rf"\A(?:{pattern})\z" if whole else pattern)

"""Text functions as native column expressions, with DuckDB twins for checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and replacements that define the cleaned text.
BANNER = r"Estamos te conectando a um especialista humano.*?:?\)\s*"
GREETING = r"Olá,?\s+[^,]+,\s+sou\s+[^,]+\s+e\s+já\s+estou\s+aqui\.?\s*"
URL = r"https?://(?:[a-zA-Z!$-_]*/([a-zA-Z!$-.0-_]*)|([a-zA-Z!$-.0-_]+))"
BEFORE_BRACKETS = [
    ("\\", " "), ("|", " "), ("\u2028", " "), ("\u2029", " "), ("—", "-"), ("–", "-"), ("´", "'"), ("`", "'"),
    ("•", "*"), ("○", "*"), ("●", "*"), ("□", "*"), ("■", "*"), ("►", ">"), ("▼", "v"), ("▲", "^"), ("◄", "<"),
]
AFTER_BRACKETS = [
    ("⭐", "*"), ("✨", "*"), ("✅", "v"), ("❌", "x"), ("❗", "!"), ("❓", "?"), ("【", "["), ("】", "]"), ("［", "["), ("］", "]"),
    ("（", "("), ("）", ")"), ("＋", "+"), ("．", "."), ("，", ","), ("：", ":"), ("／", "/"), ("＊", "*"), ("＿", "_"), ("～", "~"),
    ("！", "!"), ("？", "?"), ("；", ";"),
    *((chr(c), " ") for c in (*range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)),
]
AI_SENDERS = ["ai", "bot", "assistant", "ai_assistant", "chatbot", "automated", "system", "auto"]
NA_VALUES = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
KEYWORD_RULES = [
    ("Agradecimento/Satisfação", ["obrigad", "agradec", "muito bom", "excelente"]),
    ("Saudação", ["oi", "ola", "bom dia", "boa tarde", "boa noite"]),
    ("Problema Técnico", ["problema", "erro", "não funciona", "defeito"]),
    ("Dúvida/Solicitação de Ajuda", ["dúvida", "como", "onde", "quando", "ajuda"]),
    ("Solicitação de Serviço", ["pedido", "solicito", "preciso", "quero"]),
    ("Reclamação", ["reclamação", "insatisfeito", "ruim", "péssimo"]),
    ("Solicitação de Informação", ["informação", "dados", "horário", "preço"]),
    ("Transferência para Humano", ["especialista", "humano", "atendente"]),
    ("Finalização/Avaliação", ["finalizada", "classifique", "avaliar"]),
]
DEFAULT_CATEGORY = "Comunicação Geral"


def _table(pairs: list[tuple[str, str]]) -> tuple[str, str]:
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (trim() takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """The cleaned text: banners and emphasis removed, addresses shortened, typographic
    characters replaced, all else that isn't ASCII deleted, white space collapsed. Null
    stays null."""
    c = F.regexp_replace(c, "(?dU)" + BANNER, "")
    c = F.regexp_replace(c, "(?U)" + GREETING, "")
    c = F.regexp_replace(c, r"\*([^*]+)\*", "$1")
    c = F.regexp_replace(c, r"[\x00-\x09\x0b-\x1f]", "")
    c = F.regexp_replace(c, URL, r"[URL: $1$2]")
    c = F.replace(F.translate(c, *_table(BEFORE_BRACKETS)), F.lit("…"), F.lit("..."))
    c = F.replace(F.replace(c, F.lit("*["), F.lit("[")), F.lit("]*"), F.lit("]"))
    c = F.translate(c, *_table(AFTER_BRACKETS))
    c = F.regexp_replace(c, r"[^\x00-\x7F]", "")
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.regexp_replace(c, r"\s+([.,!?;:])", "$1")


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean_text_sql(x: str) -> str:
    """clean_text for DuckDB."""
    sub = lambda e, p, r: f"regexp_replace({e}, {_quote(p)}, {_quote(r)}, 'g')"
    x = sub(sub(sub(x, BANNER, ""), GREETING, ""), r"\*([^*]+)\*", r"\1")
    x = sub(sub(x, r"[\x00-\x09\x0b-\x1f]", ""), URL, r"[URL: \1\2]")
    a, b = _table(BEFORE_BRACKETS)
    x = f"replace(translate({x}, {_quote(a)}, {_quote(b)}), '…', '...')"
    x = f"replace(replace({x}, '*[', '['), ']*', ']')"
    a, b = _table(AFTER_BRACKETS)
    x = f"translate({x}, {_quote(a)}, {_quote(b)})"
    x = f"trim({sub(sub(x, '[^\\x00-\\x7F]', ''), r'\s+', ' ')})"
    return sub(x, r"\s+([.,!?;:])", r"\1")


def estimate_tokens(c: Column) -> Column:
    """A token for every four characters, rounded down."""
    return F.floor(F.length(c) / 4).cast("long")


def word_count(c: Column) -> Column:
    """Words between white space; none in a blank text."""
    return F.when(F.trim(F.regexp_replace(c, r"\s+", " ")) == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "))).cast("long")


def sentence_marks(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[.!?]"))


def accented(c: Column) -> Column:
    """Accented Latin letters."""
    return F.regexp_count(c, F.lit("[àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ]"))


def keyword_category(c: Column) -> Column:
    """The first rule with a word in the lower-case text."""
    low, out = F.lower(c), None
    for name, words in KEYWORD_RULES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(DEFAULT_CATEGORY)


def keyword_category_sql(x: str) -> str:
    rules = " ".join("WHEN " + " OR ".join(f"contains(lower({x}), {_quote(w)})" for w in words) + f" THEN {_quote(name)}" for name, words in KEYWORD_RULES)
    return f"CASE {rules} ELSE {_quote(DEFAULT_CATEGORY)} END"


def conversation_line(sender: Column, text: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(sender, F.lit("UNKNOWN")), F.lit("]: "), text)


def ticket_block(ticket_id: Column, text: Column) -> Column:
    return F.concat(F.lit("Ticket "), ticket_id, F.lit(":\n"), text)


def ticket_ids_in(c: Column) -> Column:
    """Ids that a text names as `Ticket 12:`."""
    return F.regexp_extract_all(c, F.lit(r"Ticket (\d+):"), 1)


def first_numbers(c: Column, n: int = 3) -> Column:
    """The first whole numbers that a text names."""
    return F.slice(F.transform(F.regexp_extract_all(c, F.lit(r"\b(\d+)\b"), 1), lambda x: x.try_cast("long")), 1, n)


def message_totals(c: Column) -> tuple[Column, Column]:
    """Number of messages and histogram text of `Total: 5 mensagens ({...})`."""
    pattern = r"Total: (\d+) mensagens \((.+)\)"
    return F.regexp_extract(c, pattern, 1).try_cast("long"), F.regexp_extract(c, pattern, 2)


def format_cost(c: Column) -> Column:
    """Costs a person can read: thousandths of cents, cents or dollars."""
    return F.when(c < 0.001, F.format_string("%.3fm¢", c * 1000)).when(c < 0.10, F.format_string("%.2f¢", c * 100)).otherwise(F.format_string("$%.3f", c))


def format_age(hours: Column) -> Column:
    return F.when(hours < 1, F.format_string("%d min", (hours * 60).cast("int"))).when(hours < 24, F.format_string("%.1f h", hours)).otherwise(F.format_string("%.1f d", hours / 24))


def category_line(number: Column, name: Column, description: Column, examples: Column) -> Column:
    """A taxonomy entry as a prompt line, with two examples at most."""
    shown = F.when(F.size(examples) > 0, F.concat(F.lit(" (ex: "), F.array_join(F.slice(examples, 1, 2), ", "), F.lit(")"))).otherwise("")
    return F.concat(number.cast("string"), F.lit(". "), name, F.lit(": "), description, shown)

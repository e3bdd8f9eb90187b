"""Messages to a model (F15) as JSON, by column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import LETTERS

#: What is said in each language.
TEXTS = {
    "de": {
        "system": (
            "Du bist ein hilfreicher Assistent für Multiple-Choice-Aufgaben.",
            "Bewertung: Eine korrekte Antwort erhält die vollen Punkte der Aufgabe; eine falsche oder nicht eindeutig auswertbare Endantwort zieht ein Viertel der Aufgabenpunkte ab; 'Ich entscheide mich, nicht zu antworten.' ergibt 0 Punkte ohne Abzug.",
            "Wähle die beste Option (A–E). Wenn die richtige Option nicht mit ausreichender Sicherheit bestimmbar ist oder die Aufgabe mehrdeutig ist, kannst du ausdrücklich mit 'Ich entscheide mich, nicht zu antworten.' antworten. Begründungen sind optional.",
            "Füge am Ende eine einzelne Zeile an: Final answer: A|B|C|D|E|Declined.",
        ),
        "question": "Frage:", "question_image": "Fragebild:", "more": "Zusatzbild", "options": "Antwortmöglichkeiten:", "option": "Option",
        "last": "Erinnere dich: Beende deine Antwort mit einer Zeile in diesem Format – Final answer: A|B|C|D|E|Declined.",
    },
    "en": {
        "system": (
            "You are a helpful assistant for multiple-choice tasks.",
            "Scoring: a correct answer earns the task's full points; an incorrect or unparseable final answer subtracts one quarter of the task's points; choosing not to answer earns 0 points with no penalty.",
            "Select the best option (A–E). If the correct option cannot be determined with sufficient confidence or the question is ambiguous, you may explicitly reply 'I choose not to answer.' Reasoning is optional.",
            "Add a single line at the end: Final answer: A|B|C|D|E|Declined.",
        ),
        "question": "Question:", "question_image": "Question image:", "more": "Additional image", "options": "Answer choices:", "option": "Option",
        "last": "Remember to finish with a line in this format – Final answer: A|B|C|D|E|Declined.",
    },
}
PART = "struct<type:string,text:string,image_url:struct<url:string,detail:string>>"


def _text(value: Column) -> Column:
    return F.struct(F.lit("text").alias("type"), value.alias("text"), F.lit(None).cast("struct<url:string,detail:string>").alias("image_url")).cast(PART)


def _image(url: Column, detail: str) -> Column:
    return F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(url.alias("url"), F.lit(detail).alias("detail")).alias("image_url")).cast(PART)


def messages(question: Column, language: Column, options: dict[str, Column], question_url: Column | None = None, more_urls: Column | None = None, option_urls: dict[str, Column] | None = None, detail: str = "auto") -> Column:
    """JSON of a system and a user message. The user's parts in order: question, its image, further images (an array; null ones keep their number), options each with its image, and what to end with.

    A null language is German, any other than German is English; an option without text keeps its line.
    """
    german = F.coalesce(F.lower(language), F.lit("de")) == "de"
    said = lambda key: F.when(german, TEXTS["de"][key]).otherwise(TEXTS["en"][key])
    none = F.array().cast(f"array<{PART}>")

    def shown(label: Column, url: Column | None) -> Column:
        """A label and an image, if there is one."""
        return none if url is None else F.when(F.length(url) > 0, F.array(_text(label), _image(url, detail))).otherwise(none)

    parts = [F.array(_text(F.concat_ws(" ", said("question"), question))), shown(said("question_image"), question_url)]
    if more_urls is not None:
        each = F.transform(more_urls, lambda url, i: F.when(F.length(url) > 0, F.array(_text(F.concat(said("more"), F.lit(" "), (i + 1).cast("string"), F.lit(":"))), _image(url, detail))).otherwise(none))
        parts.append(F.coalesce(F.flatten(each), none))
    parts.append(F.array(_text(said("options"))))
    for letter in LETTERS:
        parts += [F.array(_text(F.concat(F.lit(f"{letter}) "), F.coalesce(options[letter], F.lit(""))))), shown(F.concat(said("option"), F.lit(f" {letter} Bild:")), (option_urls or {}).get(letter))]
    parts.append(F.array(_text(said("last"))))
    system = {k: json.dumps("\n".join(v["system"]), ensure_ascii=False) for k, v in TEXTS.items()}
    head = F.when(german, system["de"]).otherwise(system["en"])
    return F.concat(F.lit('[{"role":"system","content":'), head, F.lit('},{"role":"user","content":'), F.to_json(F.concat(*parts)), F.lit("}]"))

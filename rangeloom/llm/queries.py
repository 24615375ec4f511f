"""Registry of the subpackage: one query per operator, and SQL where SQL can express it."""

from __future__ import annotations

from .decontam import op4_decontamination
from .exact import OP3_SQL, op3_exact_dedup
from .html import op2_html_text
from .langid import op6_language
from .mixing import OP10_SQL, op10_mixing
from .quality import op5_quality
from .simhash import op1_simhash
from .suffix import op9_suffix_dedup
from .toxicity import op7_toxicity
from .warc import OP8_SQL, op8_warc_fixity


def queries() -> dict:
    return {
        "op1_simhash": op1_simhash,
        "op2_html_text": op2_html_text,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_decontamination": op4_decontamination,
        "op5_quality": op5_quality,
        "op6_language": op6_language,
        "op7_toxicity": op7_toxicity,
        "op8_warc_fixity": op8_warc_fixity,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op8_warc_fixity": OP8_SQL, "op10_mixing": OP10_SQL}

"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from noticelake.llm.bpe import op9_bpe
from noticelake.llm.context_mixing import op4_context_mixing
from noticelake.llm.divergence import OP11_SQL, op11_divergence
from noticelake.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from noticelake.llm.fingerprints import op10_fingerprints
from noticelake.llm.html_text import op1_html_text
from noticelake.llm.language import op8_language
from noticelake.llm.mixing import op12_mixing
from noticelake.llm.packing import op2_packing
from noticelake.llm.simhash import op5_simhash
from noticelake.llm.spelling import op13_spelling
from noticelake.llm.token_files import op3_token_files
from noticelake.llm.warc import op7_warc


def queries() -> dict:
    found = [
        op1_html_text,
        op2_packing,
        op3_token_files,
        op4_context_mixing,
        op5_simhash,
        op6_exact_dedup,
        op7_warc,
        op8_language,
        op9_bpe,
        op10_fingerprints,
        op11_divergence,
        op12_mixing,
        op13_spelling,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL, "op11_divergence": OP11_SQL}

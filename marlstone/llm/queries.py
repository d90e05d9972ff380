"""The corpus operators' registered queries."""

from __future__ import annotations

from marlstone.llm import fm, lines, minhash, quotes, recompress, spaced, tokens, warc, wrapper

QUERIES = {
    "op1_line_frequency": lines.op1_line_frequency,
    "op2_factorisation": fm.op2_factorisation,
    "op3_recompression": recompress.op3_recompression,
    "op4_spaced_seeds": spaced.op4_spaced_seeds,
    "op5_byte_bpe": tokens.op5_byte_bpe,
    "op6_warc": warc.op6_warc,
    "op7_minhash": minhash.op7_minhash,
    "op8_wrappers": wrapper.op8_wrappers,
    "op9_quotation_linking": quotes.op9_quotation_linking,
    "op10_token_counts": tokens.op10_token_counts,
}
SQL: dict[str, str] = {
    "op1_line_frequency": lines.OP1_SQL,
    "op3_recompression": recompress.OP3_SQL,
    "op4_spaced_seeds": spaced.OP4_SQL,
    "op6_warc": warc.OP6_SQL,
    "op7_minhash": minhash.OP7_SQL,
    "op9_quotation_linking": quotes.OP9_SQL,
}

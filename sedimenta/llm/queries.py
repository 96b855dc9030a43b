"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from sedimenta.llm import benchmarks, chats, fill_in_middle
from sedimenta.llm.benchmarks import op8_decontamination
from sedimenta.llm.chats import op4_chats
from sedimenta.llm.conversation_repair import op13_conversation_repair
from sedimenta.llm.fill_in_middle import op11_fill_in_middle
from sedimenta.llm.language_id import op6_language_id
from sedimenta.llm.secrets import op9_secrets
from sedimenta.llm.sentencepiece_codec import op2_sentencepiece
from sedimenta.llm.simhash import op1_simhash
from sedimenta.llm.sketches import op5_sketches
from sedimenta.llm.substrings import op7_substrings
from sedimenta.llm.super_minhash import op12_minhash
from sedimenta.llm.token_counts import op10_token_counts
from sedimenta.llm.token_files import op3_token_files

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_token_files": op3_token_files,
    "op4_chats": op4_chats,
    "op5_sketches": op5_sketches,
    "op6_language_id": op6_language_id,
    "op7_substrings": op7_substrings,
    "op8_decontamination": op8_decontamination,
    "op9_secrets": op9_secrets,
    "op10_token_counts": op10_token_counts,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_minhash": op12_minhash,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL = {
    "op4_chats": chats.SQL,
    "op8_decontamination": benchmarks.SQL,
    "op11_fill_in_middle": fill_in_middle.SQL,
}

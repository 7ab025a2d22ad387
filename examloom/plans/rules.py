"""Weighted regex rules for the supplied multilingual corpus (a parameter of the classifier)."""

S, W = 3, 1

RULES: list[tuple[str, str, int]] = [
    ("english", r"\bthat\b", S), ("english", r"\bwith\b", S), ("english", r"\bthe\b", W), ("english", r"\bfrom\b", S),
    ("english", r"\bthis\b", S), ("english", r"\band\b", W), ("english", r"\bwhich\b", S),
    ("french", r"\bpour\b", S), ("french", r"\bdans\b", S), ("french", r"\bavec\b", S), ("french", r"\bdes\b", W),
    ("french", r"\bune?\b", W), ("french", r"\bque\b", W),
    ("german", r"\bnicht\b", S), ("german", r"\bsich\b", S), ("german", r"\beine?\b", S), ("german", r"\bund\b", W),
    ("german", r"\bder\b", W), ("german", r"\bfur\b", S),
    ("spanish", r"\bpara\b", S), ("spanish", r"\bpor\b", W), ("spanish", r"\blos\b", W), ("spanish", r"\blas\b", W),
    ("spanish", r"cion\b", S), ("spanish", r"mente\b", W),
    ("abstract-nouns", r"tion\b", W), ("abstract-nouns", r"ment\b", W), ("abstract-nouns", r"heit\b", W),
    ("abstract-nouns", r"keit\b", W), ("abstract-nouns", r"able\b", W), ("abstract-nouns", r"tionn?[aeiou]", W),
    ("adverbs", r"lich\b", W), ("adverbs", r"\w{4}ly\b", W), ("adverbs", r"\w{2}mente\b", W),
    ("licensing", r"licen[cs]e", S), ("licensing", r"copyright", S), ("licensing", r"permission", S),
    ("licensing", r"all rights reserved", S), ("licensing", r"redistribut", S), ("licensing", r"warrant", W),
    ("secrets", r"password", S), ("secrets", r"api.?key", S), ("secrets", r"\bakia[0-9a-z]{8,}", S),
    ("secrets", r"secret", W), ("secrets", r"\btoken\b", W), ("secrets", r"private key", S),
    ("contacts", r"\b\d{3}[ .\-]\d{3}[ .\-]\d{4}\b", S), ("contacts", r"e-?mail", W), ("contacts", r"\.com\b", W),
    ("contacts", r"\+\d{1,3}[ \-]\d", S), ("contacts", r"\b(?:tel|phone|call)\b", W),
    ("web", r"https?:", S), ("web", r"\bwww\.", S), ("web", r"\bcookies?\b", S), ("web", r"click here", S),
    ("web", r"subscribe", W), ("web", r"\blogin\b", W),
    ("numbers", r"\b\d{4}\b", W), ("numbers", r"\d+\.\d+", W), ("numbers", r"\b\d{1,2}:\d{2}\b", W),
    ("filler", r"lorem ipsum", S), ("filler", r"(?:\bthe\b.{0,20}){2}", W),
]

"""Forms of personal data written out by hand, apart from the generator that the random field learns from, and numbers that are none."""

import re

import pytest

from playerday.llm.pii import fit, pii_spans

FOUND = {
    "email": [
        "mail jdoe[@]example.com today", "Write to Jane.Doe at example.com please", "jane_doe<at>example<dot>com", "sales(at)firm.co.uk", "Contact: m.muster [at] beispiel [dot] de", "bob.smith @ mail.example.org",
        "peter AT firma DOT de", "the box is anna-k{at}posta.it.", "j.r.2 at library.edu", "help(@)shop.net or call", "info [at] verein.org", "reach li_wei@example[.]com", "k.lopez(at)correo(dot)es", "t_99 @ host . org",
    ],
    "ip": ["gateway 172 . 16 . 4 . 9 is down", "host 10[.]0[.]0[.]7", "8(.)8(.)4(.)4", "192.168.1[.]10 answered", "ip 10 dot 1 dot 2 dot 3", "server 203[dot]0[dot]113[dot]9"],
    "card": ["card 4111.1111.1111.1111", "visa 4012 - 8888 - 8888 - 1881", "5555/5555/5555/4444", "mastercard 5105  1051  0510  5100", "card no 378282246310005", "6011.1111.1111.1117 expires"],
    "phone": [
        "06 12 34 56 78", "tel:5551234567", "call 91 98765 43210", "(415) 555-0132", "ring 0171/5551234", "0049 30 1234567", "phone 1 (212) 555-0187", "212.555.0143", "mobile: 07700 900123", "fax 030-98765432", "01-42-68-53-00", "my cell is 646 555 0199", "00 44 20 7946 0958",
    ],
}
NONE = [
    "meet me at example.com tomorrow", "look at this. com is a word", "version 1.2.3.4567", "on 2021-03-14 15:09", "14/03/2021", "pages 120-134", "order 20210314-22", "ISBN 978-3-16-148410-0", "1,234,567 items", "pi is 3.14159265358",
    "a score of 21 - 17 - 3", "the years 1914 1918 1939 1945", "cost 12 500 000 euros", "in 1999 2000 and 2001", "10:20:30 and 11:22:33", "invoice 00012345678", "4111 1111 1111 1112 fails", "row 3 . 14 . 900 . 2000 of", "section 4.2.1", "lot 55/1234",
    "chapters 1 2 3 4 5 6 7 8", "5 @ 3 euros", "he was at work. at home", "build 2024.10.0.12345", "he sat at table 12. nine left", "serial 123456789012345678", "mm 12.5 x 30.25 x 9.125", "dates 1.2.2003-4.5.2006", "ratio 16:9 at 1080p", "zip 12345-6789",
]

#: Written after the forms were set and measured once; the field is not fitted to them.
UNSEEN = {
    "email": ["anne.b [at] uni-x [dot] edu", "mail: tom(at)acme.io", "Kim_Lee at example.org!", "support{at}shop{dot}com", "r2d2[at]droid.net", "ask x.y.z @ corp.example.com"],
    "ip": ["ping 192[.]168[.]0[.]12", "addr 10 . 20 . 30 . 40", "172.16.0(.)1", "1 dot 1 dot 1 dot 1"],
    "card": ["4111/1111/1111/1111", "amex 3714 496353 98431", "4242  4242  4242  4242", "4000.0566.5566.5556"],
    "phone": ["call 1-800-555-0199", "0123 456789", "tel. 040 / 123456", "(02) 9876 5432", "0161 496 0000", "49 170 1234567", "555-867-5309", "02 99 88 77 66", "whatsapp 98765 43210", "0031 20 123 4567"],
}
UNSEEN_NONE = [
    "see room at hotel.com for more", "1 2 3 4 5 6 7", "2020-01-01 to 2020-12-31", "v10.0.19041.1", "total 1 234 567,89", "12/24/2020 10:30", "EAN 4006381333931", "3.5 x 4.5 x 5.5", "rows 100-200, 300-400", "chapter 12. 3. 4",
    "GPS 52.5200 13.4050", "tax id 123-45", "0 1 0 1 1 0 1 0", "ticket 8812-3345", "10.000.000 km", "she arrived at noon. com", "44 45 46 47 48 49", "2001 2002 2003", "1e10 vs 2e11", "case 12-34567",
]


@pytest.fixture(scope="module")
def model(spark):
    return fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def missed(model, forms):
    out = []
    for kind, texts in forms.items():
        for text in texts:
            spans = [(k, text[s:e]) for k, s, e in pii_spans(text, model)]
            digits = lambda x: re.sub(r"\D", "", x)
            if len(spans) != 1 or spans[0][0] != kind or (kind != "email" and digits(spans[0][1]) != digits(text)):
                out.append((kind, text, spans))
    return out


def test_written_forms_are_found(model):
    """Nine in ten entities at least, each as one span of its kind, of numbers with all their digits."""
    bad = missed(model, FOUND)
    assert len(bad) * 10 <= sum(map(len, FOUND.values())), bad


def test_unseen_forms_are_found(model):
    bad = missed(model, UNSEEN)
    assert len(bad) <= 4, bad  # of 24


def test_other_numbers_are_left_alone(model):
    flagged = [(t, pii_spans(t, model)) for t in NONE + UNSEEN_NONE if pii_spans(t, model)]
    assert not flagged

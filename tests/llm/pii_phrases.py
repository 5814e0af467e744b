"""Texts with known personal information, phrased apart from the sentences the model is trained on.

Frames and values were written by hand; no frame is one of ``pii_model``. ``*`` stands for the value. Names come from the
list given, and from ``UNLISTED``, which is shaped like the list but not in it.
"""

FRAMES = {
    "email": (
        "Could you forward this thread to * when you get a minute?", "Billing questions go to * only.", "* has not answered since Friday", "Please add * to the invite list, then close this.", "The newsletter bounced for * again",
        "Subscribed address - *", "My colleague (*) will take over next week.", "Reset the password of *, it expired.", "user_email: *", "Reply-To: *",
    ),
    "phone": (
        "You can get hold of me under * until six.", "Our hotline is *, weekdays only", "My new mobile number is *", "Fax the signed form to *.", "If the alarm goes off, ring * at once", "Contact number: *",
        "Leave a voicemail at *, I check it daily", "whatsapp me, *", "office line *, ask for reception", "The courier rang from *",
    ),
    "id_number": (
        "Her social security number is *, please remove it.", "my SSN (*) ended up in the ticket", "passport number * was visible in the screenshot", "Someone pasted their national insurance number * into chat", "ID card * expired in May",
        "tax id * is printed on the invoice", "the visa form asks for the passport, mine is *", "Identity document no. *", "his DNI is *", "Personalausweis *, gültig bis 2030",
    ),
    "address": (
        "Deliveries should go to *", "Since March our new office has been at *.", "The meetup takes place at *, second floor", "Return label: *", "Her flat at * has no lift", "Registered office: *", "Visitors: come to * and sign in", "Mail it to *; no signature needed",
        "I grew up at *", "The van is parked in front of *",
    ),
    "name": (
        "Yesterday * merged the branch.", "Please ask * whether the numbers are final", "Best wishes, *", "* is on holiday until Tuesday", "The review by * was thorough", "cc: *", "I met * at the conference and we fixed it", "Approved by *", "Author: *, 2024", "Thank you * for the quick answer",
    ),
}
VALUES = {
    "email": ("maria.lopez@mailhost.example", "j_smith99@corp.example.net", "info+alerts@shop.test", "K.Ito@uni.example.ac.jp", "anna-b@xn.example.de"),
    "phone": ("212-555-0173", "(415) 555-0126", "+1 646 555 0110", "+44 20 7946 0018", "+49 30 1234567"),
    "id_number": {
        0: ("219-09-9999", "457 55 5462"), 1: ("078-05-1120", "219-09-8888"), 2: ("C4812907", "X 123456"), 3: ("AB123456C", "JG 10 37 59 A"), 4: ("L01X00T47", "K7654321"), 5: ("912-70-1234", "987654321"),
        6: ("P1234567", "M4567890"), 7: ("T22000129", "X98765432"), 8: ("12345678Z", "87654321X"), 9: ("T22K12345", "L01X12345"),
    },
    "address": ("42 Elm Street, Fairview", "7 Church Lane, Little Marlow", "1600 Pine Avenue, Springdale", "Lindenstraße 12, 10969 Berlin", "Calle Mayor 5, 28013 Madrid", "PO Box 4512, Greenville", "221 Baker Road, Flat 3, Oldham"),
}
UNLISTED = ("Kelmira Osthidahl", "Ruvnora Halkagard", "Sorlyn Mirbewick", "Talmine Yarnovale", "Velkara Fendobery", "Jordora Quilresley")
#: What looks like such data but is none.
DECOYS = (
    "The backup took 5400 seconds and wrote 1099511627776 bytes.", "see RFC 2616 section 14.9 for details", "build 4.12.7-rc1 passed on node-17", "clone ssh://git@code.example:2222/team/repo.git first", "ssh root@10.2.3.4 and check dmesg", "lodash@4.17.21 has a fix",
    "Error 1045 (28000) at line 312", "commit 9fceb02d0ae598e95dc970b74767f19372d61af8 broke it", "throughput rose from 1200 to 4500 requests", "Chapter 11, page 204, figure 3.2", "the meeting is on 2025-03-14 at 10:30", "retry after 120000 ms", "order 20250314-0042 shipped", "192.168.100.200 is unreachable",
    "Use the Street View layer", "PO Box fields are optional in the schema", "the parser stopped at line 9 Drive letters", "Python 3.12 and Node 20 are required", "sha256 sums differ", "@team please vote", "version 1.0.0-beta.3 is out", "price: 1.299,00 EUR", "Windows Server needs a reboot", "The New Release works",
)


def examples(names: list[tuple[str, str]]):
    """``(text, kind)``; the names are every ninth given and family name of the list and those that are not on it."""
    given, family = ([n for n, k in names if (k == "given") == first][::9] for first in (True, False))
    people = [f"{g} {f}" for g, f in zip(given, family)] + list(UNLISTED)
    for kind, frames in FRAMES.items():
        for i, frame in enumerate(frames):
            values = people[i % 2 :: 2] if kind == "name" else VALUES[kind][i] if kind == "id_number" else VALUES[kind]
            for value in values:
                yield frame.replace("*", value), kind

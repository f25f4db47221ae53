"""Default rule tables of the feedback engine; every operator takes its table as a parameter."""

from __future__ import annotations

import os
import re
import zipfile
from functools import lru_cache
from pathlib import Path

import pyspark
from pyspark.ml.feature import StopWordsRemover

# Valences of the starter lexicon.
LEXICON = {
    "good": 1.5, "great": 2.0, "excellent": 2.5, "amazing": 2.5, "love": 2.0, "loved": 2.0, "best": 2.0, "perfect": 2.5,
    "happy": 1.5, "fast": 1.0, "easy": 1.0, "helpful": 1.5, "friendly": 1.0, "beautiful": 1.8, "recommend": 1.5, "works": 0.5,
    "bad": -1.5, "terrible": -2.5, "awful": -2.0, "horrible": -2.0, "worst": -2.0, "hate": -2.0, "hated": -2.0, "broken": -1.5,
    "slow": -1.0, "difficult": -1.0, "rude": -1.5, "expensive": -0.5, "disappointed": -1.8, "useless": -2.0, "waste": -1.8, "fail": -1.5,
    "failed": -1.5, "crash": -1.5, "crashed": -1.5, "buggy": -1.5, "ok": 0.0, "okay": 0.0, "fine": 0.0, "average": 0.0,
}

# Aspects and their surface forms.
ASPECTS = {
    "price": ["price", "pricing", "cost", "expensive", "cheap", "affordable"],
    "delivery": ["delivery", "shipping", "shipment", "delivered", "courier"],
    "packaging": ["packaging", "package", "box", "wrapping"],
    "customer service": ["customer service", "support", "customer support", "helpline"],
    "battery": ["battery", "battery life", "charge", "charging"],
    "performance": ["performance", "speed", "lag", "fast", "slow"],
    "usability": ["usability", "ease of use", "user friendly", "user-friendly", "interface"],
    "quality": ["quality", "build quality", "durability", "sturdy"],
    "design": ["design", "look", "appearance", "style"],
    "availability": ["availability", "stock", "in stock", "out of stock"],
    "sound": ["sound", "audio", "sound quality"],
    "camera": ["camera", "photo", "picture quality"],
    "screen": ["screen", "display"],
}

# Phrases of each feedback category, between word boundaries.  A question goes on to its mark.
CATEGORIES = {
    "PRAISE": r"love|excellent|great|amazing|fantastic|works perfectly|highly recommend",
    "COMPLAINT": r"disappointed|terrible|awful|does not work|doesn't work|poor quality|very bad",
    "BUG": r"bug|glitch|crash(?:es|ed)?|error message|app freezes?",
    "FEATURE_REQUEST": r"please add|wish(?: it)? had|would like (?:to )?see|request(?:ing)? (?:a )?feature",
    "QUESTION": r"what|how|when|where|why|can|does|is",
    "USABILITY": r"hard to use|difficult to navigate|confusing|not intuitive|easy to use",
    "PERFORMANCE": r"slow|laggy|lags|long loading|takes too long|unresponsive",
    "SUPPORT": r"customer support|customer service|support team|support agent|support",
    "PRICING": r"price|pricing|expensive|overpriced|too costly|subscription fee",
    "CHURN": r"cancel(?:ling|ed)?|unsubscribe|switching away|leaving this product|stop using",
    "PRIVACY": r"privacy|tracking me|excessive permissions|personal data exposure|data leak",
    "FRAUD": r"fraud|scam|phishing|fraudulent charge|unauthori[sz]ed charge",
}
TAILS = {"QUESTION": r"[^.!?\n]{0,180}\?"}

# Security findings, their severity and their phrases.
SECURITY = {
    "ACCOUNT_COMPROMISE": ("HIGH", r"account was taken over|account takeover|unauthori[sz]ed (?:login|access)|someone logged in without permission"),
    "PERSONAL_DATA_EXPOSURE": ("HIGH", r"exposed my personal data|leaked my (?:personal )?data|other users can see my data|data breach"),
    "PAYMENT_FRAUD": ("HIGH", r"fraudulent charge|unauthori[sz]ed charge|payment fraud|charged without (?:my )?authori[sz]ation"),
    "PHISHING_OR_IMPERSONATION": ("MEDIUM", r"phishing (?:email|message|link)|impersonating (?:the )?(?:company|support)|fake support account"),
    "AUTHENTICATION_FAILURE": ("MEDIUM", r"mfa code (?:never arrived|does not work)|locked out after password reset|cannot reset my password"),
    "MALWARE_REPORT": ("HIGH", r"installed spyware|ransomware encrypted|downloaded malware|malware infected"),
    "APPLICATION_VULNERABILITY_REPORT": ("MEDIUM", r"sql injection|cross[- ]site scripting|exposed api key|insecure direct object reference"),
    "TLS_CERTIFICATE_FAILURE": ("LOW", r"expired tls certificate|invalid ssl certificate|certificate warning"),
}
#: Category that a finding adds where the text is not in it already; others add SECURITY.
FINDING_CATEGORY = {"PAYMENT_FRAUD": "FRAUD", "PERSONAL_DATA_EXPOSURE": "PRIVACY"}

# What stands before the destination of a switch, and before its reason.
SWITCHES = (
    r"\b(?:switch(?:ing|ed)?|mov(?:e|ing|ed))\s+(?:from\s+.{1,80}?\s+)?to\s+",
    r"\b(?:leav(?:e|ing|es)|mov(?:e|ing|ed))\s+.{1,80}?\s+for\s+",
    r"\bchoos(?:e|ing|es)?\s+",
    r"\breplac(?:e|ing|ed)\s+.{1,80}?\s+with\s+",
)
REASON = r"\b(?:because|since|as)\s+([^.!?\n]{1,240})"

# Brand by host; the first one that fits.  A dot at the end asks for it, or for the bare name.
SOURCE_LABELS = (("amazon.", "Amazon"), ("flipkart.", "Flipkart"), ("twitter.com", "Twitter/X"), ("x.com", "Twitter/X"), ("reddit.com", "Reddit"), ("github.com", "GitHub"), ("google.com", "Google"))

# Words by which English is guessed.
ENGLISH_HINTS = "the is and a of to in i it this that was are for with on as but not have be so do at or from by an we you".split()

# A version, as root-cause evidence names it.
VERSION = r"(?:version|release|v)\s*([0-9]+(?:\.[0-9]+){1,3})"

#: Edges of a word, for letters and digits of any script.
EDGE = r"[^\p{L}\p{N}_]"


def phrase(words: str, tail: str = "") -> str:
    """Regular expression of phrases between word boundaries, without case."""
    return rf"(?iU)\b(?:{words})\b{tail}"


def literals(words: str) -> list[str]:
    """Of each alternative of a phrase pattern, what it begins with for certain, in lower case:
    plain texts to look for before a regular expression runs."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(words + "|"):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            plain = re.match(r"[^()\[\]\\?*+{}.|^$]*", words[start:k]).group()
            rest = words[start + len(plain) : k]
            # an optional last letter is not certain
            out.append((plain[:-1] if rest[:1] in ("?", "*", "{") else plain).lower())
            start = k + 1
    return sorted(set(out))

# Degree words of the published valence rules, and how much they add or take off.
_MORE = (
    "absolutely amazingly awfully completely considerable considerably decidedly deeply effing enormous enormously entirely especially "
    "exceptional exceptionally extreme extremely fabulously flipping flippin frackin fracking fricking frickin frigging friggin fully "
    "fuckin fucking fuggin fugging greatly hella highly hugely incredible incredibly intensely major majorly more most particularly "
    "purely quite really remarkably so substantially thoroughly total totally tremendous tremendously uber unbelievably unusually utter utterly very"
).split()
_LESS = (
    "almost,barely,hardly,just enough,kind of,kinda,kindof,kind-of,less,little,marginal,marginally,occasional,occasionally,partly,"
    "scarce,scarcely,slight,slightly,somewhat,sort of,sorta,sortof,sort-of"
).split(",")
DEGREES = {w: 0.293 for w in _MORE} | {w: -0.293 for w in _LESS}

# Negations of these rules; a token with n't is one, too.
NEGATIONS = (
    "aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't didn't doesn't dont hadnt hasnt havent isnt "
    "mightnt mustnt neither don't hadn't hasn't haven't isn't mightn't mustn't neednt needn't never none nope nor not nothing nowhere "
    "oughtnt shant shouldnt uhuh wasnt werent oughtn't shan't shouldn't uh-uh wasn't weren't without wont wouldnt won't wouldn't rarely seldom despite"
).split()

# Idioms whose valence is not that of their words.
IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "badass": 1.5, "bus stop": 0.0, "yeah right": -2.0, "kiss of death": -1.5,
    "to die for": 3.0, "beating heart": 3.1, "broken heart": -2.9,
}

# Capitals, a negation, degree words further away, exclamation and question marks, the compound's normalisation.
CAPITALS, TURN, FADING, CALL, ASK, ASKS, ALPHA = 0.733, -0.74, (1.0, 0.95, 0.9), 0.292, 0.18, 0.96, 15


def _stop_list(language: str) -> list[str]:
    """Spark's list of a language: from the running session, else from the jar of the Spark that would be started."""
    try:
        return StopWordsRemover.loadDefaultStopWords(language)
    except AttributeError:  # no session runs in this process
        for home in (Path(pyspark.__file__).parent, Path(os.environ.get("SPARK_HOME", "/"))):
            for jar in home.glob("jars/spark-mllib_*.jar"):
                with zipfile.ZipFile(jar) as z:
                    return z.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt").decode().split()
    raise LookupError("no Spark session runs and no jar of Spark's is found: start a session before stop words are asked for")


@lru_cache
def stop_words(*languages: str) -> tuple[str, ...]:
    """Spark's own stop words of the languages, as keyword tokens: three ASCII letters or more."""
    words = [w for x in languages for w in _stop_list(x)]
    return tuple(dict.fromkeys(w for w in words if re.fullmatch("[a-z]{3,}", w)))

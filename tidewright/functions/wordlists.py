"""Vocabularies that results depend on, in their natural order."""

# Financial words of clear direction.
POSITIVE_WORDS = (
    "profit profitable profitability revenue growth beat exceeded outperform upgrade upside bullish momentum strong "
    "strengthens record soar rally surge boost dividend buyback acquisition robust breakthrough innovative expansion "
    "gain recovery rebound overweight optimistic confident accelerating improving efficient leading dominant milestone "
    "delivers exceed outpaces favorable solid healthy resilient advantage raised lifted upgraded"
).split()
NEGATIVE_WORDS = (
    "loss losses deficit bankruptcy default downgrade miss missed shortfall warning volatile volatility risk risks "
    "liability liabilities debt fraud investigation lawsuit decline declining downturn recession layoffs restructuring "
    "impairment writedown write-off restatement bearish underperform downside slump plunge slash weak weakening "
    "disappointing underweight concern uncertainty headwind challenging struggling suspended halted penalty fine recall "
    "breach probe subpoena dilution dilutive squeeze crisis contagion exposure cut"
).split()

# Words without direction in a financial text.
NEUTRAL_WORDS = (
    "market stock share shares option options merger interest rate capital fund quarter annual fiscal earnings price "
    "volume position holding stake trade trading portfolio index sector"
).split()

# Valences of newswire words.
HEADLINE_WORDS = {
    "beats": 2.0, "beat": 2.0, "topped": 1.5, "surpasses": 2.0, "surpassed": 2.0, "exceeded": 1.5, "exceeds": 1.5,
    "outperforms": 2.0, "outperformed": 2.0, "raises": 1.5, "upgrade": 1.5, "upgraded": 1.5, "lifted": 1.5,
    "rallies": 1.5, "surges": 1.5, "soars": 1.5, "record": 1.0, "dividend": 1.5, "buyback": 1.5, "bullish": 1.5,
    "overweight": 1.0, "misses": -2.0, "missed": -2.0, "slumps": -2.0, "plunges": -2.0, "tumbles": -2.0,
    "downgrade": -2.0, "downgraded": -2.0, "bearish": -1.5, "underweight": -1.0,
}

# Phrases and their adjustments; earlier ones hide what they cover from later ones.
CONTEXT_PHRASES = {
    "earnings beat": 2.5, "earnings miss": -2.5, "record earnings": 2.0, "record revenue": 2.0, "record profit": 2.0,
    "beats estimates": 2.0, "misses estimates": -2.0, "beats expectations": 2.0, "misses expectations": -2.0,
    "profit warning": -2.5, "guidance cut": -2.5, "raised guidance": 2.0, "lowered guidance": -2.0,
    "dividend cut": -2.0, "dividend increase": 1.8, "dividend hike": 1.8, "stock buyback": 1.5,
    "share repurchase": 1.5, "chapter 11": -3.5, "going concern": -3.0, "accounting fraud": -3.5,
    "sec investigation": -2.5, "class action": -2.0, "credit downgrade": -2.5, "credit upgrade": 2.0,
    "cash flow positive": 2.5, "debt restructuring": -1.5, "file for bankruptcy": -3.0, "filed for bankruptcy": -3.0,
    "files for bankruptcy": -3.0, "ipo": 1.0, "initial public offering": 1.0,
}

# Negators and intensifiers of the published valence rules, with the rules' constants.
NEGATORS = (
    "aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't didn't doesn't dont hadnt "
    "hasnt havent isnt mightnt mustnt neither don't hadn't hasn't haven't isn't mightn't mustn't neednt needn't never "
    "none nope nor not nothing nowhere oughtnt shant shouldnt uhuh wasnt werent oughtn't shan't shouldn't uh-uh wasn't "
    "weren't without wont wouldnt won't wouldn't rarely seldom despite no"
).split()
INTENSIFIERS = (
    "absolutely amazingly awfully completely considerable considerably decidedly deeply enormous enormously entirely "
    "especially exceptional exceptionally extreme extremely fabulously fully greatly highly hugely incredible "
    "incredibly intensely major majorly more most particularly purely quite really remarkably so substantially "
    "thoroughly total totally tremendous tremendously unbelievably unusually utter utterly very"
).split()
DAMPENERS = "almost barely hardly kinda less little marginal marginally occasional occasionally partly scarce scarcely slight slightly somewhat".split()
INTENSITY, NEGATION, CAPITALS, ALPHA = 0.293, -0.74, 0.733, 15.0
EXCLAMATION, QUESTION, QUESTIONS = 0.292, 0.18, 0.96

# The labels.
POSITIVE, NEUTRAL, NEGATIVE = "positif", "neutre", "négatif"

# Words that decide a model's reply without a number.
REPLY_POSITIVE = "positive bullish optimistic beat strong".split()
REPLY_NEGATIVE = "negative bearish pessimistic miss weak loss".split()

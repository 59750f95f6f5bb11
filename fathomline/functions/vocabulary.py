"""Patterns by which documents are found relevant, and sorted into kinds, sub-categories, templates and tags."""

from __future__ import annotations

# All tables of this module. Patterns are matched without regard to case.
RELEVANCE = (
    r"\bfutures?\b", r"\bcommodit(y|ies)\b", r"\bderivativ", r"\bmanaged[\s-]+futures?\b", r"\bCTA\b", r"\btrend[\s-]+follow", r"\bmomentum\b", r"\bcarry\b", r"\bterm[\s-]+structure\b",
    r"\bbasis\b", r"\bcontango|backwardation\b", r"\bhedg(e|ing)\b", r"\bmean[\s-]+revers", r"\bstatistical[\s-]+arbitrage|stat[\s-]?arb\b", r"\bpairs[\s-]+trading\b",
    r"\bvolatility[\s-]+(risk|premium|arbitrage)", r"\bquant(itative)?[\s-]+(strateg|trad|invest)", r"\bfactor[\s-]+(invest|model|premia)", r"\brisk[\s-]+parity\b", r"\bcommodity[\s-]+pool\b", r"\bRoll[\s-]+yield\b",
)

FACTOR = (
    r"\bfactors?\b", r"\bcross[- ]?sectional\b", r"\banomal(y|ies)\b", r"\bcharacteristics?\b", r"\brisk premi", r"\bfama[- ]?french\b", r"\bfactor model", r"\bfactor zoo\b", r"\bsmart beta\b",
    r"\breturn predictab", r"\bexpected returns?\b", r"\bbetting[- ]against[- ]beta\b", r"\bstyle investing\b", r"\bfactor premi", r"\bfactor investing\b", r"\bfactor exposure",
)
STRATEGY = (
    r"\btrading strateg", r"\btrading rule", r"\btrading system", r"\bbacktest", r"\bexecution\b", r"\bmarket timing\b", r"\btechnical indicator", r"\btrend[- ]?follow", r"\bpairs[- ]?trad",
    r"\bmarket[- ]making\b", r"\border book\b", r"\bhigh[- ]frequency trad", r"\btrading signal", r"\boverlay\b", r"\bportfolio strateg", r"\bbuy[- ]and[- ]hold\b", r"\bentry/exit\b",
)

FACTOR_SUBCATS = {
    "value": (r"\bvalue (factor|premium|investing|effect|stock)", r"\bbook[- ]to[- ]market\b", r"\bvaluation ratio"),
    "size": (r"\bsize (factor|premium|effect)", r"\bsmall[- ]cap\b", r"\bsmb\b"),
    "momentum": (r"\bmomentum\b", r"\bcross[- ]sectional momentum\b", r"\brelative strength\b"),
    "quality": (r"\bquality (factor|premium)", r"\bprofitabilit", r"\bearnings quality\b"),
    "low-volatility": (r"\blow[- ]volatility\b", r"\blow[- ]vol\b", r"\bminimum variance\b", r"\bdefensive\b"),
    "investment": (r"\binvestment factor\b", r"\basset growth\b", r"\bcapex\b"),
    "liquidity": (r"\bliquidity (factor|premium|risk)", r"\billiquidit"),
    "carry": (r"\bcarry (factor|trade)", r"\bterm[- ]structure\b", r"\broll yield\b"),
    "dividend": (r"\bdividend (yield|factor)", r"\bpayout\b"),
    "reversal": (r"\breversal\b", r"\bshort[- ]term reversal\b", r"\blong[- ]term reversal\b"),
    "sentiment": (r"\bsentiment\b", r"\binvestor attention\b"),
    "macro": (r"\bmacro(economic)? factor", r"\binflation\b", r"\bbusiness cycle\b"),
    "esg": (r"\besg\b", r"\bsustainab", r"\bgreen\b", r"\bclimate (risk|factor)", r"\bbiodiversity\b"),
    "betting-against-beta": (r"\bbetting[- ]against[- ]beta\b", r"\bbab\b", r"\blow[- ]beta\b"),
}
STRATEGY_SUBCATS = {
    "trend-following": (r"\btrend[- ]?follow", r"\bcta\b", r"\bmanaged futures\b"),
    "time-series-momentum": (r"\btime[- ]?series momentum\b", r"\btsmom\b"),
    "cross-sectional-momentum": (r"\bcross[- ]?sectional momentum\b", r"\bxsmom\b"),
    "mean-reversion": (r"\bmean[- ]?reversion\b", r"\bmean[- ]?revert", r"\bcontrarian\b", r"\bover[- ]?bought\b", r"\bover[- ]?sold\b"),
    "breakout": (r"\bbreakout\b", r"\bdonchian\b", r"\bchannel breakout\b"),
    "pairs-trading": (r"\bpairs?[- ]trad",),
    "statistical-arbitrage": (r"\bstatistical[- ]arbitrage\b", r"\bstat[- ]?arb\b", r"\bcointegrat"),
    "market-making": (r"\bmarket[- ]making\b", r"\bliquidity provision\b", r"\bbid[- ]ask spread\b"),
    "event-driven": (r"\bevent[- ]driven\b", r"\bearnings (drift|surprise)", r"\bmerger\b", r"\bm&a\b", r"\bannouncement\b"),
    "volatility": (r"\bvolatility (target|trading)", r"\bvix\b", r"\bvariance (risk|premium|swap)", r"\bgarch\b"),
    "options": (r"\boptions?\b", r"\bimplied volatility\b", r"\bcall option\b", r"\bput option\b"),
    "technical": (r"\btechnical (analysis|indicator|trading)", r"\brsi\b", r"\bmacd\b", r"\bmoving average", r"\bvisibility graph\b", r"\badx\b"),
    "machine-learning": (r"\bmachine learning\b", r"\bdeep learning\b", r"\bneural network", r"\breinforcement learning\b", r"\blstm\b"),
    "high-frequency": (r"\bhigh[- ]frequency\b", r"\bhft\b", r"\border flow\b", r"\bmicrostructure\b"),
    "arbitrage": (r"\barbitrage\b",),
}

TEMPLATES = {
    "momentum": (r"\bmomentum\b", r"\btime[- ]?series\s+momentum\b", r"\bcross[- ]?sectional\s+momentum\b", r"\btrend[- ]?following\b", r"\btsmom\b", r"\bxsmom\b", r"\bcta\b", r"\bbreakout\b"),
    "mean_reversion": (
        r"\bmean[- ]?reversion\b", r"\breversal\b", r"\bcontrarian\b", r"\brsi\b", r"\boscillator\b", r"\bovershoot\b", r"\bover[- ]?bought\b", r"\bover[- ]?sold\b", r"\bpairs\s+trad",
        r"\bstatistical\s+arbitrage\b", r"\bstat[- ]?arb\b", r"\bcointegrat",
    ),
    "buy_and_hold": (),
}
TEMPLATE_TAGS = {"momentum": ("momentum",), "mean_reversion": ("mean-reversion", "technical"), "buy_and_hold": ("baseline", "buy-and-hold")}

FAMILY = {
    "momentum": (r"\bmomentum\b", r"\btsmom\b", r"\bxsmom\b", r"\brelative strength\b"),
    "trend-following": (r"\btrend[- ]?following\b", r"\btrend[- ]?follow", r"\bcta\b", r"\bmanaged futures\b"),
    "mean-reversion": (r"\bmean[- ]?reversion\b", r"\bmean[- ]?revert", r"\breversal\b", r"\bcontrarian\b", r"\bover[- ]?bought\b", r"\bover[- ]?sold\b"),
    "breakout": (r"\bbreakout\b", r"\bdonchian\b", r"\bchannel breakout\b"),
    "pairs-trading": (r"\bpairs?[- ]trad", r"\bpair[- ]trad"),
    "statistical-arbitrage": (r"\bstatistical[- ]arbitrage\b", r"\bstat[- ]?arb\b", r"\bcointegrat"),
    "carry": (r"\bcarry\b", r"\bterm[- ]structure\b", r"\broll yield\b", r"\bbasis trad"),
    "value": (r"\bvalue (factor|premium|investing|strateg|effect)", r"\bbook[- ]to[- ]market\b", r"\bvaluation ratio"),
    "factor": (r"\bfactor (model|investing|premi|portfolio|zoo)", r"\bmulti[- ]?factor\b", r"\bsmart beta\b", r"\bsize factor\b", r"\bquality factor\b", r"\brisk factor"),
    "volatility": (r"\bvolatility\b", r"\bvariance\b", r"\bvix\b", r"\bgarch\b", r"\bvol[- ]target", r"\bvolatility targeting\b"),
    "event-driven": (r"\bevent[- ]driven\b", r"\bearnings (drift|surprise|announce)", r"\bpost[- ]earnings\b", r"\bmerger\b", r"\bm&a\b", r"\bannouncement\b"),
    "market-making": (r"\bmarket[- ]making\b", r"\bliquidity provision\b", r"\bbid[- ]ask spread\b"),
    "arbitrage": (r"\barbitrage\b",),
}
SIGNAL = {
    "technical": (r"\btechnical (analysis|indicator|trading)", r"\brsi\b", r"\bmacd\b", r"\bmoving average", r"\boscillator\b", r"\bbollinger\b", r"\badx\b"),
    "fundamental": (r"\bfundamental(s| analysis| signal| data)", r"\bbalance sheet\b", r"\bcash flow\b", r"\baccounting\b"),
    "cross-sectional": (r"\bcross[- ]?sectional\b",),
    "time-series": (r"\btime[- ]?series\b",),
    "regime-aware": (r"\bregime\b", r"\bmarkov\b", r"\bhidden markov\b", r"\brandom matrix\b", r"\brmt\b", r"\bregime[- ]switch"),
    "machine-learning": (r"\bmachine learning\b", r"\bdeep learning\b", r"\bneural network", r"\brandom forest\b", r"\bxgboost\b", r"\bgradient boost", r"\breinforcement learning\b", r"\blstm\b", r"\btransformer\b"),
    "sentiment": (r"\bsentiment\b", r"\bnews[- ]based\b", r"\btext mining\b", r"\bnlp\b", r"\bnatural language\b"),
    "microstructure": (r"\bmicrostructure\b", r"\border book\b", r"\border flow\b", r"\blimit order\b", r"\bhigh[- ]frequency trad"),
    "graph-based": (r"\bvisibility graph\b", r"\bgraph theor", r"\bcomplex network\b", r"\bnetwork analysis\b"),
}
DIRECTION = {
    "long-short": (r"\blong[- ]short\b", r"\blong/short\b"),
    "market-neutral": (r"\bmarket[- ]neutral\b", r"\bbeta[- ]neutral\b", r"\bdollar[- ]neutral\b"),
    "long-only": (r"\blong[- ]only\b",),
}
INSTRUMENT = {
    "index-future": (r"\bindex futures?\b", r"\bstock index futures?\b"),
    "stock-future": (r"\bsingle[- ]stock futures?\b", r"\bstock futures?\b"),
    "single-stock": (r"\bsingle[- ]stock\b",),
}
REGION = {
    "taiwan": (r"\btaiwan\b", r"\btwse\b", r"\btaiex\b", r"\btwii\b"),
    "us": (r"\bunited states\b", r"\bu\.s\.\b", r"\bus equit", r"\bs&p\s?500\b", r"\bnasdaq\b", r"\bnyse\b", r"\bdow jones\b"),
    "china": (r"\bchina\b", r"\bchinese\b", r"\ba[- ]shares?\b", r"\bshanghai\b", r"\bshenzhen\b", r"\bcsi\s?300\b"),
    "japan": (r"\bjapan\b", r"\bnikkei\b", r"\btopix\b"),
    "europe": (r"\beuropean?\b", r"\beuro[- ]?stoxx\b", r"\bftse\b", r"\bdax\b"),
    "global": (r"\bglobal\b", r"\binternational market", r"\bcross[- ]countr", r"\bg5\b", r"\bg7\b"),
    "emerging-markets": (r"\bemerging market",),
}
ASSET_CLASS = {
    "equity": (r"\bequit", r"\bstock market\b", r"\bstocks?\b", r"\bshares?\b"),
    "futures": (r"\bfutures?\b",),
    "options": (r"\boptions?\b", r"\bimplied volatility\b", r"\bcall option\b", r"\bput option\b"),
    "fx": (r"\bforeign exchange\b", r"\bcurrenc", r"\bfx market\b"),
    "fixed-income": (r"\bbonds?\b", r"\btreasur", r"\byield curve\b", r"\bfixed[- ]income\b"),
    "crypto": (r"\bcrypto", r"\bbitcoin\b", r"\bethereum\b"),
    "commodity": (r"\bcommodit", r"\bcrude oil\b", r"\bgold\b"),
}
DIMENSIONS = {"family": FAMILY, "signal": SIGNAL, "direction": DIRECTION, "instrument": INSTRUMENT, "region": REGION, "asset_class": ASSET_CLASS}

"""Column predicates of transcripts, gaps, identities and proposals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Marks of music and of other sounds in captions, words of events, of links between them, of emotions.
MUSIC_CUES = r"\[(?:음악|노래|music|bgm|브금)\]"
SOUND_CUES = r"\[(?:박수|웃음|비명|환호|효과음|소음|무음)\]"
CUE_MARKS = r"""[>♪♫♬♩~…·.,!?！？:;(){}"'`\-_/\\|]+"""
EVENT_WORDS = r"갑자기|결국|드디어|성공|실패|됐다|안\s*돼|왜|어떻게|뭐야|잠깐|헐|대박|미안|죄송|사과|실수|놀라|웃|울|화나|이겼|졌|잡았|죽었|살았|찾았|발견|반전|문제|사건|because|suddenly|finally|sorry|won|lost|found|what|why|how"
LINK_WORDS = r"그래서|그런데|근데|하지만|왜냐하면|그러다가|그다음|이후|전에|때문에|사실은|알고\s*보니|즉|반면|결과|결국|then|but|however|therefore|after|before|because"
EMOTIONS = r"excited|happy|joy|surprise|surprised|sad|angry|fear|laugh|cry|흥분|기쁨|놀람|슬픔|화남|웃음|울음"
NO_SPEECH = "[대사 없음]"
EXCLUDED_CATEGORY, EXCLUDED_REASONS = "music-or-intermission", ("music-or-song", "opening-ending-or-break")
RETRYABLE_GAPS = ("pending", "decode-failed", "transcription-failed", "rate-limited")
FREE, PAID = "free-r2", "paid-direct"


def is_music_only(text: Column) -> Column:
    """A caption that is marked as music and has fewer than two Korean syllables left without its marks."""
    bare = T.composed(text)
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, f"(?iu){MUSIC_CUES}", " "), f"(?iu){SOUND_CUES}", " "), CUE_MARKS, " ")
    return bare.rlike(f"(?iu){MUSIC_CUES}") & (F.regexp_count(rest, F.lit("[가-힣]")) < 2)


def is_program_material(category: Column, reasons: Column) -> Column:
    """Music, breaks, openings and endings, by category or by a reason of rejection."""
    return F.coalesce(category == EXCLUDED_CATEGORY, F.lit(False)) | F.coalesce(F.arrays_overlap(reasons, F.array(*map(F.lit, EXCLUDED_REASONS))), F.lit(False))


def should_expand(text: Column, emotion: Column) -> Column:
    """A chunk of 18 letters or more with two of four signals: a question or call, an event, a link, an emotion."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    found = [flat.rlike("[?!？！]"), flat.rlike(f"(?iu)(?:{EVENT_WORDS})"), flat.rlike(f"(?iu)(?:{LINK_WORDS})"), F.coalesce(emotion.rlike(f"(?iu)(?:{EMOTIONS})"), F.lit(False))]
    signals = found[0].cast("int")
    for s in found[1:]:
        signals = signals + s.cast("int")
    return F.coalesce((F.char_length(flat) >= 18) & (signals >= 2), F.lit(False))


def is_no_speech(text: Column, no_speech: Column, log_probability: Column) -> Column:
    """Surely without speech: the sentinel text, or a high probability of silence with a low one of the words."""
    return F.coalesce(text == NO_SPEECH, F.lit(False)) | F.coalesce((no_speech >= 0.98) & (log_probability <= -1), F.lit(False))


def needs_paid_retry(reason: Column, attempts: Column) -> Column:
    """A gap whose request may have been billed: it was sent, and how it ended is not known."""
    return (reason == "outcome-unknown") | ((reason == "in-flight") & (attempts > 0))


def retryable(reason: Column, attempts: Column, transport: Column) -> Column:
    """Gaps that are tried again by themselves."""
    return reason.isin(*RETRYABLE_GAPS) | ((transport == FREE) & needs_paid_retry(reason, attempts))


def retryable_when_paid(reason: Column, attempts: Column, transport: Column) -> Column:
    """Gaps that are tried again only if a person agrees to pay."""
    return (transport == PAID) & needs_paid_retry(reason, attempts)


def identity_basis(manual: Column, registered: Column, fingerprint: Column, editor: Column, fits) -> tuple[Column, Column]:
    """Basis and video of the identity in order of trust; the first that is given decides, and none is taken whose time
    line does not fit. fits(video): null if the catalog does not have the video, which only manual and registered ids
    may lack."""
    given = [("manual-pasted", manual, True), ("registered-local-binding", registered, True), ("visual-fingerprint-consensus", fingerprint, False), ("editor-confirmed-catalog", editor, False)]
    basis, video = F.lit(None), F.lit(None)
    for name, column, unknown_too in reversed(given):
        sound = F.coalesce(fits(column), F.lit(unknown_too))
        basis = F.when(column.isNotNull(), F.when(sound, name)).otherwise(basis)
        video = F.when(column.isNotNull(), F.when(sound, column)).otherwise(video)
    return basis, video


def compare_only_reason(same_segment: Column, trashed: Column, review: Column, editing: Column, pinned: Column, run_allowed: Column, same_revision: Column) -> Column:
    """Why a proposal may only be compared; null if it may be applied. The first matching rule counts."""
    return (
        F.when(~same_segment, "segment_id_mismatch").when(trashed, "segment_trashed").when(review == "rejected", "segment_rejected").when(review != "unreviewed", "review_state_not_unreviewed")
        .when(editing, "user_is_editing").when(pinned, "proposal_is_pinned").when(~run_allowed, "analysis_run_not_allowed").when(~same_revision, "user_revision_mismatch")
    )


def duration_tolerance(duration: Column) -> Column:
    """A thousandth of the length, between two and ten seconds."""
    return F.least(F.lit(10_000), F.greatest(F.lit(2_000), F.floor(duration * 0.001 + 0.5))).cast("long")


def luma(red: Column, green: Column, blue: Column) -> Column:
    """Brightness of a pixel by the weights of ITU-R BT.709."""
    return 0.2126 * red + 0.7152 * green + 0.0722 * blue


# The number in an address, and after the site's name.
REPLAY_ADDRESS = r"(?iu)(?:https?://)?(?:www\.)?chzzk\.naver\.com/(?:video|videos)/(\d{7,12})(?:[/?#]|\z)"
REPLAY_NAMED = r"(?iu)(?:chzzk|치지직)[^\d]{0,12}(\d{7,12})(?!\d)"


def replay_number(name: Column) -> Column:
    """Number of a replay in an address or after the site's name; bare numbers do not count. Names are composed first."""
    name = F.coalesce(T.nfc(F.when(T.needs_nfkc(name), name)), name)
    address, named = F.regexp_extract(name, REPLAY_ADDRESS, 1), F.regexp_extract(name, REPLAY_NAMED, 1)
    return F.coalesce(F.when(address != "", address), F.when(named != "", named))


def stable_id(*parts: Column) -> Column:
    """An id that is the same wherever and whenever it is made of the same parts."""
    return F.left(T.content_fingerprint(*(p.cast("string") for p in parts)), F.lit(16))

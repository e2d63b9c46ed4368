"""Fixed values of the data contract.

Everything in this file is a fixed value: word lists, lookup tables, weights and
thresholds that results depend on.  Nothing here is computed.
"""

# Article categories with their numeric section codes.
CATEGORY_CODES = {
    "정치": 100, "경제": 101, "사회": 102, "생활/문화": 103,
    "세계": 104, "IT/과학": 105, "연예": 106, "스포츠": 107,
}

# Display order of the category dashboard, and the labels it leaves out.
CATEGORY_DISPLAY_ORDER = ["IT/과학", "경제", "사회", "생활/문화", "세계", "정치", "연예", "스포츠"]
UNSORTED_CATEGORIES = ["미분류", "일반"]
RATE_HIDDEN_CATEGORIES = ["연예", "스포츠"]

# Event types that count as a positive signal.
POSITIVE_EVENTS = ["view_article_detail", "view_detail", "click_article", "click_related", "click_feedback"]
CLICKED_EVENTS = ["view_article_detail", "view_detail", "click_article", "click_related"]
FUNNEL_STEPS = ["visit_main", "view_article_detail", "open_trust_modal", "click_feedback"]
RECOMMENDATION_SURFACE = "personalized_recommendation"
DELETED_TITLE = "알 수 없는 기사(삭제됨)"
UNKNOWN_SOURCE = "미상"
UNKNOWN_DATE = "날짜미상"

# Outlet tiers of the source rule.
SOURCE_TIERS = {
    10: ["연합뉴스", "KBS", "MBC", "SBS", "YTN"],
    8: ["조선일보", "중앙일보", "동아일보", "한겨레", "경향신문",
        "한국일보", "국민일보", "서울신문", "세계일보", "문화일보"],
    6: ["머니투데이", "뉴시스", "아시아경제", "뉴스1", "헤럴드경제",
        "이데일리", "파이낸셜뉴스", "아주경제", "데일리안", "매일경제"],
    3: ["온라인 커뮤니티", "카카오스토리", "네이버 블로그", "티스토리",
        "인스타그램", "페이스북", "유튜브"],
}
SOURCE_DEFAULT = 5
SOURCE_REASON_UNKNOWN = "출처 미상 — 중립 처리"
SOURCE_REASON_EXACT = "등록 언론사: "
SOURCE_REASON_PARTIAL = "부분 일치: "
SOURCE_REASON_UNLISTED_HEAD = "미등록 언론사: "
SOURCE_REASON_UNLISTED_TAIL = " — 중립 처리"

# Trust criteria, question counts and weight sets (production is W2).
CRITERIA = ["source_credibility", "evidence_support", "style_neutrality", "logical_consistency", "clickbait_risk"]
QUESTION_COUNTS = {"evidence_support": 5, "style_neutrality": 3, "logical_consistency": 4, "clickbait_risk": 3}
WEIGHT_SETS = {
    "W0": [0.25, 0.25, 0.20, 0.20, -0.10],
    "W1": [0.20, 0.25, 0.25, 0.15, -0.15],
    "W2": [0.20, 0.20, 0.25, 0.15, -0.20],
    "W3": [0.20, 0.25, 0.25, 0.20, -0.10],
    "W4": [0.15, 0.30, 0.25, 0.20, -0.10],
}
PRODUCTION_WEIGHTS = "W2"
GOLD_GRID = {
    "source_credibility": [0.15, 0.20, 0.25],
    "evidence_support": [0.20, 0.25, 0.30],
    "style_neutrality": [0.20, 0.25, 0.30],
    "logical_consistency": [0.15, 0.20, 0.25],
    "clickbait_risk": [-0.05, -0.10, -0.15],
}
ANSWER_YES, ANSWER_NO, ANSWER_OTHER = 1.0, 0.0, 0.3
NO_ANSWER_REASON = "답변 없음"
FAILED_REASON = "분석 실패"
FAILURE_PREFIX = "신뢰도 분석 실패: "
VERDICT_TRUE_FROM, VERDICT_UNCERTAIN_FROM = 70, 40
SHORT_ARTICLE_CHARS = 300
TRIM_FRONT, TRIM_TAIL, TRIM_MARK = 2500, 1500, "\n\n...(중략)...\n\n"

# Recommender.
HISTORY_SIZE = 20
SHORT_TERM_WEIGHT = 0.65
RECENCY_HALF_LIFE = 5.0
RELEVANCE_FLOOR = 0.35
MAX_CATEGORY_SHARE = 0.6
EXPLORE_MIN_LIMIT = 5
EXPLORE_POOL = 10
LOW_TRUST_BELOW = 40
RECENT_EXCLUDED = 5
RERANK_WEIGHTS = [0.10, 0.60, 0.10, 0.20]

# Search.
BM25_K1, BM25_B, BM25_FLOOR = 1.5, 0.75, 0.25
BM25_MIN_SCORE = 0.3
SEMANTIC_MIN_SCORE = 0.5
RELATED_MIN_SCORE = 0.65
RRF_K = 60
OVERFETCH = 5
GATE_SCORE, GATE_SEMANTIC, GATE_BM25 = 0.6, 0.55, 0.5

# Fact-check verdict words and their labels.
JUDGE_LABELS = {
    "사실": 1.0, "대체로 사실": 0.75, "절반의 사실": 0.5,
    "판단 유보": 0.5, "대체로 사실 아님": 0.25, "전혀 사실 아님": 0.0,
}
JUDGE_DEFAULT = 0.5

# Outlet names, in matching order, for fact-check source strings.
KNOWN_OUTLETS = [
    "연합뉴스", "KBS", "MBC", "SBS", "JTBC", "YTN", "TV조선", "채널A", "MBN",
    "조선일보", "중앙일보", "동아일보", "한겨레", "경향신문",
    "한국일보", "국민일보", "서울신문", "세계일보", "문화일보",
    "서울경제", "한국경제", "매일경제", "머니투데이", "뉴시스", "뉴스1",
    "헤럴드경제", "이데일리", "파이낸셜뉴스", "아주경제", "데일리안",
    "뉴스핌", "뉴스위크", "시사저널", "주간조선",
    "의학신문", "데일리메디", "청년의사",
    "천지일보", "미디어오늘", "오마이뉴스", "프레시안",
    "대한민국 정책브리핑", "정책브리핑",
]
UNCRAWLABLE_WORDS = [
    "인터넷 커뮤니티", "커뮤니티 게시물",
    "페이스북", "트위터", "인스타그램", "유튜브",
    "디시인사이드", "네이트판", "인스티즈", "클리앙", "개드립", "시보드",
    "카카오", "밴드",
]
SPEECH_WORDS = [
    "국정감사", "국회 발언", "의원총회", "유세 발언", "대통령", "청와대",
    "브리핑", "위원회", "모두발언", "유세", "인터뷰", "포럼", "발표",
]
SELF_RAISED_WORDS = ["언론사 자체 문제제기", "언론사 자체 문제 제기", "다수 언론"]

# Words that never count as a summary keyword.
STOP_WORDS = [
    "이", "가", "을", "를", "은", "는", "의", "에", "에서", "로", "으로",
    "과", "와", "것", "수", "등", "및", "또한", "그리고", "그러나", "하지만",
    "때문에", "통해", "대해", "위해", "따라", "관련", "이후", "이전", "현재",
    "이번", "있는", "없는", "하는", "되는", "했다", "한다", "된다", "있다", "없다",
]

# Key fragments whose values are hidden in event payloads.
SENSITIVE_KEYS = ["password", "token", "secret", "api_key", "authorization"]
REDACTED, TRUNCATED, MAX_LOG_STRING = "[REDACTED]", "...[TRUNCATED]", 500

# Chunking.
CHUNK_SIZE, CHUNK_OVERLAP = 400, 150
CHUNK_SEPARATORS = ["다.\n", "다. ", ".\n", ". ", "\n\n", "\n", " ", ""]

# Texts of the summary step.
SUMMARY_FAILED = "요약 추출 실패"
LENGTH_GUIDES = {"short": "핵심 위주로 아주 짧게 2문장 내외",
                 "medium": "중요 내용을 포함하여 3~4문장 내외",
                 "long": "전체 맥락을 파악할 수 있도록 5~6문장 내외"}

# CSS selectors of the page parsers.
PAGE_SELECTORS = {
    "publisher": ["em.media_end_head_top_logo img", ".logo img", ".press_logo img",
                  "img.NewsEndMain_press_logo_img__hOOfx"],
    "title": ["h2#title_area", ".media_end_head_headline", "h2.end_tit", "h4.title",
              ".NewsEndMain_article_title__kqEzS", ".news_tit", ".title_area"],
    "date": ["span.media_end_head_info_datestamp_time", "span.author > em", "div.info span",
             ".NewsEndMain_date__J_2A1", ".date_time", ".info_date"],
    "body": ["div._article_content", "#dic_area", "#articeBody", "#newsEndContents",
             ".NewsEndMain_article_content__1We_E", "#articleBody", ".news_end"],
    "drop": ["script", "style", ".ad_area", ".img_desc"],
    "reporter": ["em.media_end_head_journalist_name", ".byline_s", ".byline", ".author > em",
                 ".NewsEndMain_byline__uEmsm", ".journalist_name"],
}
DIRECT_BODY_SELECTORS = ["article", "div#article-view-content-div", "div.article_txt",
                         "div#newsct_article", "div.news_cnt_detail_wrap", "div#content"]
DIRECT_DROP_SELECTORS = ["script", "style", "figure", ".ad"]

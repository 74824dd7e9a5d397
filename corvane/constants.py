"""Word lists, patterns and thresholds that results depend on."""

from __future__ import annotations

# Sites in registry order, (key, domain, only reached directly).
SITES = (
    ("zhihu", "zhihu.com", False), ("csdn", "csdn.net", False), ("cnblogs", "cnblogs.com", False), ("segmentfault", "segmentfault.com", False),
    ("v2ex", "v2ex.com", False), ("infoq", "infoq.cn", False), ("bilibili", "bilibili.com", False), ("youtube", "youtube.com", False),
    ("xiaohongshu", "xiaohongshu.com", False), ("x", "x.com", False), ("juejin", "juejin.cn", False), ("wechat", "mp.weixin.qq.com", False),
    ("hackernews", "", True), ("github", "github.com", True), ("arxiv", "arxiv.org", True), ("rss", "", True), ("web", "", False),
)
# Query parameters that only track, as one pattern, and those a site needs.
TRACKING = r"^(utm_.*|fbclid|gclid|yclid|msclkid|ref|ref_?src|source|spm|share_?.*|from|_?from|vd_source|buvid|wfr|s_r|scene|clicktime|weibo_id|sr_share|utm)$"
KEEP = {"youtube.com": ("v", "list"), "bilibili.com": ("bvid", "aid", "p"), "x.com": ("status",), "arxiv.org": ("v",)}

# Words that say nothing about a topic.
GENERIC = "进行 使用 需要 可以 应该 能够 具有 包括 属于 通过 关于 由于 因为 所以 但是 however based 了解 知道 觉得 认为 希望 喜欢 大家 我们 你们 他们 自己 什么 怎么 如何 哪些 这个 那个 这些 那些 这样 那样 一个 一些 一种 更多 非常 特别 比较 真的 确实 其实 可能 或者 以及 并且 而且 如果 只是 就是 还是 然后 现在 今天 今年 目前 已经 还有 没有 不是 不能 不会 一定 必须 开始 出现 发现 看到 得到 成为 作为 东西 方式 方便 选择 享受 体验 生活 感觉 感受 效果 情况 时候 推荐 分享 自动 相关 注意 考虑".split()
BOILERPLATE = "首页 登录 注册 收藏 点赞 评论 转发 关注 订阅 阅读 全文 原文 详情 更多 相关 推荐阅读 广告 版权 声明 转载 来源 编辑 作者 责任编辑 版权所有 免责声明 联系我们 关于我们 隐私政策 click here read more share comment subscribe cookie privacy policy terms login sign http https www com html htm".split()
ENGLISH = "the and for with that this from have has had was were are you your our their its his her but not all can will would could should may one two also into than then them these those what when where which who how why been being about after before over under out off get got just like make made use used using see seen new old more most much many some any each very well only even back still here there".split()
STOPWORDS = tuple(dict.fromkeys([*GENERIC, *BOILERPLATE, *ENGLISH]))

# Industries by label.
INDUSTRIES = {
    "大模型/AI": ("大模型", "LLM", "人工智能", "机器学习", "深度学习", "推理", "训练", "Transformer", "MoE", "Agent"),
    "芯片半导体": ("芯片", "半导体", "晶圆", "制程", "EDA", "GPU", "NPU", "光刻", "封装", "存算一体"),
    "生物医药": ("生物医药", "药物", "临床", "基因", "蛋白", "靶点", "抗体", "疫苗", "医疗器械"),
    "新能源": ("新能源", "电池", "光伏", "储能", "风电", "氢能", "电动车", "固态电池", "电网"),
    "金融科技": ("金融科技", "支付", "量化", "风控", "清算", "区块链", "数字货币", "征信"),
    "企业软件": ("企业软件", "SaaS", "ERP", "CRM", "协同办公", "云原生", "中间件", "数据库", "DevOps"),
    "消费电子": ("消费电子", "智能手机", "可穿戴", "无人机", "智能家居", "XR", "VR", "AR", "耳机"),
}

# Domains that are reached directly, and hosts that are nobody else's.
DOMESTIC = (
    "bilibili.com", "hdslb.com", "biliapi.net", "zhihu.com", "zhimg.com", "xiaohongshu.com", "xhscdn.com", "baidu.com", "bdstatic.com", "bdimg.com", "weibo.com", "weibo.cn",
    "sina.com.cn", "douyin.com", "ixigua.com", "csdn.net", "juejin.cn", "cnblogs.com", "gitee.com", "qq.com", "163.com", "sohu.com", "alipay.com",
)
PRIVATE_HOST = r"^(localhost|::1|0\.0\.0\.0)$|\.(localhost|local)$|^127\.|^10\.|^192\.168\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^169\.254\.|^fe80:|^f[cd][0-9a-f]{0,2}:"

# Hosts and patterns of pages that are not about a topic.
JOB_DOMAINS = ("zhipin.com", "lagou.com", "liepin.com", "51job.com", "zhaopin.com", "yingjiesheng.com", "nowcoder.com", "maimai.cn")
TRADE_DOMAINS = ("xianyu.com", "goofish.com", "zhuanzhuan.com", "paipai.com")
JOB_SUBDOMAINS = ("job", "jobs", "careers", "career", "zhaopin", "hr")
TENDER_TITLE = r"(招标公告|中标公告|询价公告|采购公告|竞争性磋商|投标邀请|中标结果公示)"
JOB_PATH = r"(?i)^/(campus|job|jobs|career|careers|intern|recruitment|position)(/|$)|(/position/\d+)"
JOB_TITLES = (r"^【[^】]*(校招|社招|春招|秋招|招聘|内推|急聘|诚聘)[^】]*】", r"(岗位职责|任职资格|职位描述|岗位要求|薪资面议)", r"(校园招聘|社会招聘|实习生招聘|招聘启事|招聘简章|职位列表|岗位列表)[\s·\-—|]*$", r"(招聘[^\s|·—]*工程师|诚聘[^\s|·—]*|急聘[^\s|·—]*|实习生招聘|校招内推)")
TRADE_TITLE = r"(转让|出售|求购|闲置)[^。]{0,20}(元|价格|包邮|议价|￥|¥)"
NON_CONTENT_PATH = r"(?i)/(search|signin|signup|login|register|captcha|verify|tag|tags|topic|category|archive|404)(/|$)"
JUNK_TITLE = r"^(首页|登录|注册|验证码|安全验证|访问异常|页面不存在|404|更多|下载|广告|推广)$"
JUNK_SNIPPET = r"(?i)(请开启\s*javascript|验证码|安全验证|访问异常|访问被拒绝|登录后查看|页面不存在|not found)"
CODE_STRONG = r"function\s*\(|window\.\w+\s*=|document\.(getElementById|querySelector)|\bvar\s+\w+\s*=|__INITIAL_STATE__|ytInitialPlayerResponse"
PLAY_MARK = r"[\d.]+\s*[万亿千]?\s*播放"
CHROME_TEXT = (r"首页\s*番剧\s*直播", r"收藏\s*稿件\s*投诉")

# Endings that tell the type of a keyword.
TYPE_ORGANISATION = r"(大学|学院|研究院|研究所|实验室|集团|公司|企业|基金会|委员会|协会|团队|中心)$"
TYPE_TECHNOLOGY = r"(算法|模型|框架|协议|架构|引擎|内核|编译器|数据库|操作系统|网络|驱动|缓存|系统)$"
TYPE_PRODUCT = r"(版|pro|max|plus|mini|lite|sdk|api|cli|app|os|平台|助手|套件)$"
TYPE_ENG_PRODUCT = r"(db|os|kit|suite|app|cloud)$"
TYPE_ENG_TECHNOLOGY = r"(net|transformer|bert|gpt|llm|cnn|rnn|gan)$"

# Thresholds.
FULL_CHARS, THIN_CHARS = 300, 120
USEFUL_WORDS = 30
WINDOW, MOST_EDGES, LEAST_WEIGHT, KEYWORDS = 15, 8, 0.6, 60
SIMHASH_DISTANCE, SIMHASH_WORDS = 8, 80
RANGES = {"day": 1, "week": 7, "month": 30, "year": 365}
MIN_TARGETS = 8

# Labels by table.
LABELS = {
    "provider": {"serper": "Serper", "searxng": "SearXNG", "ytdlp": "yt-dlp", "bilibili": "B 站接口", "hackernews": "Hacker News", "github": "GitHub API", "arxiv": "arXiv", "rss": "RSS 订阅"},
    "span": {"day": "一天内", "week": "一周内", "month": "一月内", "year": "一年内"},
    "sort": {"relevant": "印证优先", "recent": "最新优先", "mixed": "印证 + 时效", "quality": "声量优先"},
    "kind_filter": {"all": "全部", "video": "仅视频", "article": "仅图文"},
    "kind": {"article": "图文", "video": "视频", "social": "社交长文", "unknown": "未知"},
    "grade": {"full": "正文完整", "thin": "正文很短", "snippet": "仅摘要"},
    "value": {"high": "高价值", "medium": "中等", "low": "低价值"},
}
# Sites searched unless told otherwise.
DEFAULT_SITES = ("zhihu", "csdn", "cnblogs", "segmentfault", "v2ex", "infoq", "juejin", "wechat", "bilibili", "youtube", "hackernews", "github", "arxiv", "rss", "web")
# Lines of a page that are nothing but a button.
BUTTONS = ("分享", "收藏", "点赞", "评论", "关注", "举报", "展开", "收起", "阅读全文")
# Feeds read where none are configured.
FEEDS = (
    ("少数派", "https://sspai.com/feed"), ("V2EX", "https://www.v2ex.com/index.xml"), ("InfoQ 中文", "https://www.infoq.cn/feed"), ("博客园", "https://feed.cnblogs.com/blog/sitehome/rss"),
    ("开源中国", "https://www.oschina.net/news/rss"), ("阮一峰的网络日志", "https://www.ruanyifeng.com/blog/atom.xml"),
)
# The head of an error that is a site's rule, and the errors that are, by site.
LIMITATION = "已知限制（不是故障）"
LIMITED = {
    "zhihu": r"HTTP 40[13]|风控|反爬", "xiaohongshu": r"HTTP 40[13]|HTTP 412|风控|300031|300012", "x": r"HTTP 40[13]|HTTP 412|风控", "bilibili": r"HTTP 412|风控",
    "wechat": r"未能提取到正文|没抽到正文|无头浏览器渲染", "youtube": r"(?i)Sign in to confirm|not a bot|confirm you're not a bot",
}
# What is said of each of them: without a login, and with one where that matters.
SITE_NOTES = {
    "zhihu": ("未登录的访问一律 403，登录后才有正文", "登录态多半已过期，需要重新登录"), "xiaohongshu": ("未登录的访问会转到登录页", "登录态多半已过期，需要重新登录"), "x": ("未登录读不到正文",),
    "bilibili": ("部分接口会返回 412，公开接口不受影响",), "wechat": ("文章页会要求验证，抓不到正文多半是平台拦截",), "youtube": ("出口地址被判为机器人",),
}

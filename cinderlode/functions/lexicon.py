"""Word lists, maps and constants that results depend on. Plain data, no logic."""

STOP_WORDS = ["how", "to", "a", "the", "on", "in", "of", "for", "with", "an", "is", "at", "by", "and", "or", "from", "my", "your", "our", "me", "us"]
CONTENT_STOP_WORDS = [*STOP_WORDS, "i", "want", "know", "using", "use", "do", "can", "get", "please", "help", "show", "view"]
REPORT_STOP_WORDS = ["a", "an", "the", "to", "into", "from", "with", "of", "for", "on", "in", "and", "or", "by", "as", "at", "how", "do", "i", "my", "this", "that", "using", "use", "via", "your", "their", "it", "its"]
FAMOUS = ["mkdir", "rmdir", "chmod", "chown", "grep", "unzip", "curl", "ping", "clear", "terminal", "history", "systemctl", "journalctl", "uptime", "whoami", "touch", "head", "tail", "kill", "pkill", "alias"]
TYPOS = {
    "makdir": "mkdir", "rmdier": "rmdir", "chomd": "chmod", "chownn": "chown", "gerp": "grep", "unzipp": "unzip", "curll": "curl", "pign": "ping", "rerminal": "terminal", "psx": "ps", "hstry": "history",
    "lss": "ls", "pwdd": "pwd", "cdd": "cd", "tars": "tar", "systmctl": "systemctl", "journlctl": "journalctl", "upime": "uptime", "whoamii": "whoami", "copiy": "cp", "mve": "mv", "toutch": "touch",
    "headd": "head", "taill": "tail", "dff": "df", "duu": "du", "kll": "kill", "pkll": "pkill", "aliass": "alias",
}
TRANSLITERATED = {
    "shanchu": "delete", "wenjian": "file", "chaxun": "search", "jincheng": "process", "jiazai": "mount", "cipan": "disk", "kaishi": "start", "jiancha": "check", "neicun": "memory", "qingchu": "clear",
    "pingmu": "screen", "liechu": "list", "mulu": "directory", "duibi": "diff", "xiazai": "download", "chuangjian": "create", "fuzhi": "copy", "yidong": "move", "kong": "empty", "xiugai": "modify",
    "quanxian": "permission", "suoyouzhi": "owner", "sousuo": "search", "ping": "ping", "wangluo": "network", "dakai": "open", "yuancheng": "remote", "yasuo": "compress", "jieya": "decompress",
}
CONCEPTS = {
    "networking": ["vpc", "subnet", "gateway", "route", "firewall"], "network": ["vpc", "subnet", "gateway", "route", "firewall"], "firewall": ["security", "firewall", "acl"],
    "storage": ["bucket", "volume", "disk", "blob"], "database": ["database", "sql", "table", "rds"], "db": ["database", "sql", "table", "rds"], "serverless": ["lambda", "function", "faas"],
    "container": ["container", "image", "pod"], "containers": ["container", "image", "pod"], "kubernetes": ["pod", "deployment", "namespace", "cluster"], "k8s": ["pod", "deployment", "namespace", "cluster"],
    "secret": ["secret", "credential", "key", "vault"], "secrets": ["secret", "credential", "key", "vault"], "dns": ["dns", "domain", "record", "zone"], "delete": ["remove", "unlink", "trash"],
    "erase": ["remove", "unlink", "trash"], "remove": ["delete", "unlink"], "clear": ["prune", "remove", "rm", "delete", "unused"], "clean": ["prune", "remove", "rm", "delete", "unused"],
    "cleanup": ["prune", "remove", "rm", "delete", "unused"], "purge": ["prune", "remove", "rm", "delete", "unused"], "prune": ["clean", "remove", "delete", "unused"], "view": ["show", "display"],
    "read": ["show", "display"], "deploy": ["apply", "install"], "deployment": ["apply", "install"], "history": ["log", "commits"], "cat": ["bat", "less", "pager"], "fuzzy": ["fzf", "skim", "finder"],
    "finder": ["find", "fd"], "download": ["curl", "wget"], "diff": ["delta", "difft"], "grep": ["ripgrep", "rg"],
}
TOOL_ALIASES = {"fuzzy": ["fzf", "skim"], "finder": ["fzf", "fd"], "download": ["curl", "wget", "aria2"], "diff": ["delta", "difft"], "grep": ["ripgrep", "rg"]}
NOISE_LEAVES = ["help", "version", "completion", "completions", "bash", "zsh", "fish", "powershell", "--help", "-h", "--version"]
COMPOUND_TOOLS = ["compose", "machine", "buildx", "swarm", "creds", "desktop", "cli"]
FUSED_SUFFIXES = ["image", "images", "container", "containers", "volume", "volumes", "network", "networks", "pod", "pods", "system"]
PATH_REWRITES = [
    ("docker_compose_up", "docker.compose.up"), ("docker_compose.up_build", "docker.compose.up"), ("docker_compose.up_detached", "docker.compose.up"),
    ("docker_compose.up_project", "docker.compose.up"), ("docker_compose.logs_container", "docker.compose.logs"), ("docker_compose", "docker.compose"),
]
DANGEROUS = ["delete", "destroy", "terminate", "remove", "rm ", "drop", "purge", "wipe", "deregister", "revoke", "kill", "force-delete", "shutdown", "rmdir"]
MEDIUM = [
    "create", "update", "modify", "put", "set", "apply", "deploy", "restart", "reboot", "scale", "attach", "detach", "rotate", "reset", "disable", "enable", "stop", "start", "prune", "push",
    "import", "restore", "rollback", "patch", "associate", "disassociate", "register", "add", "remove-",
]
LIBRARY_PATTERN = "(?i)(^python-|^python2-|^perl-|^ruby-|^haskell-|^ghc-|^rust-|^nodejs-|^golang-|^php-|-sdk$|-headers$|-dev$|-docs?$|-debug$|-bindings$|-typelib$|-stubs$)"
LONG_TAIL_PATTERN = "(?i)(^lib|-git$)"
LIBRARY_ALLOWED = ["libtree", "python-llm", "libcaca", "libxml2", "libreoffice"]
INSTALL_TEMPLATES = {
    "pacman": "pacman -S ", "apt": "apt install ", "dnf": "dnf install ", "apk": "apk add ", "emerge": "emerge ", "zypper": "zypper install ", "yum": "yum install ", "brew": "brew install ",
    "scoop": "scoop install ", "choco": "choco install ", "nix-env": "nix-env -iA nixpkgs.", "nix_env": "nix-env -iA nixpkgs.", "yay": "yay -S ", "paru": "paru -S ", "pip": "pip install ",
    "npm": "npm install -g ", "cargo": "cargo install ",
}
SYSTEM_MANAGERS = ["apt", "pacman", "dnf", "apk", "emerge", "zypper", "yum"]
FALLBACK_MANAGERS = ["cargo", "pip", "pipx", "uv", "npm", "go", "brew"]
OS_MANAGERS = {
    "macos": "brew", "windows": "scoop", "arch": "pacman", "ubuntu": "apt", "debian": "apt", "fedora": "dnf", "centos": "yum", "rhel": "yum", "gentoo": "emerge", "alpine": "apk", "opensuse": "zypper", "nixos": "nix-env",
}
KNOWN_MANAGERS = [
    "pacman", "yay", "paru", "brew", "apt", "apt-get", "dnf", "zypper", "snap", "flatpak", "scoop", "winget", "cargo", "npm", "pip", "go", "curl", "wget", "docker", "nix", "uv", "pipx", "nix-env", "nix_env",
    "choco", "chocolatey", "apk", "emerge", "pkg", "xbps", "guix", "conda", "mamba",
]
#: Repository name prefix -> package manager; the first that matches counts.
REPOSITORY_PREFIXES = [
    ("debian", "apt"), ("ubuntu", "apt"), ("kali", "apt"), ("linuxmint", "apt"), ("raspbian", "apt"), ("fedora", "dnf"), ("epel", "dnf"), ("centos", "dnf"), ("alpine", "apk"), ("gentoo", "emerge"), ("nix", "nix-env"),
    ("opensuse", "zypper"), ("freebsd", "pkg"), ("pkgsrc", "pkg"), ("scoop", "scoop"), ("chocolatey", "choco"), ("winget", "winget"), ("homebrew", "brew"), ("macports", "brew"), ("arch", "pacman"), ("artix", "pacman"),
    ("manjaro", "pacman"), ("aur", "yay"), ("crates_io", "cargo"), ("pypi", "pip"),
]
#: The longer table, of repository names as a live index gives them.
INDEX_PREFIXES = [
    ("debian", "apt"), ("ubuntu", "apt"), ("kali", "apt"), ("raspbian", "apt"), ("linuxmint", "apt"), ("parrot", "apt"), ("pureos", "apt"), ("devuan", "apt"), ("trisquel", "apt"), ("pardus", "apt"), ("fedora", "dnf"),
    ("epel", "dnf"), ("openeuler", "dnf"), ("rosa", "dnf"), ("centos", "dnf"), ("alpine", "apk"), ("gentoo", "emerge"), ("liguros", "emerge"), ("nix_", "nix-env"), ("nixpkgs", "nix-env"), ("opensuse", "zypper"),
    ("freebsd", "pkg"), ("openbsd", "pkg"), ("pkgsrc", "pkg"), ("scoop", "scoop"), ("chocolatey", "choco"), ("winget", "winget"), ("homebrew", "brew"), ("macports", "brew"), ("arch", "pacman"), ("artix", "pacman"),
    ("manjaro", "pacman"), ("parabola", "pacman"), ("archpower", "pacman"), ("aur", "yay"), ("crates_io", "cargo"), ("pypi", "pip"),
]
#: Repositories whose packages are known by their source's name, and managers whose commands name an app's packages.
BY_SOURCE_NAME = ["gentoo", "liguros"]
PACKAGE_MANAGERS = ["pacman", "apt", "brew", "cargo", "dnf", "zypper", "apk", "yay", "pip", "npm"]
BAD_DESCRIPTIONS = ["a tool", "a cli", "a command", "a utility", "todo", "placeholder", "unknown", "n/a", "none", "example", "test"]
SHELL_OPERATORS = ["|", "&&", "||", ";", ">", "<", ">>", "2>"]
RISKS = ["safe", "medium", "dangerous"]
#: Ranking constants.
RRF_K, POOL_FTS, POOL_FTS_SCOPED, POOL_VEC, POOL_VEC_SCOPED = 60, 300, 100, 200, 100
APPS_KEPT, APPS_INJECTED, APPS_CAP, POOL_LEAST, PER_APP = 5, 5, 8, 30, 3
HARD_DISTANCE, SOFT_DISTANCE = 0.82, 0.76
POPULARITY_CAP = 100

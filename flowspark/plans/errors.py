"""Error numbers of the flow API (fixed values: clients and tests compare them)."""

from enum import IntEnum


class Err(IntEnum):
    BPF_SYNTAX = 1025
    OPEN_FILE = 1026
    STRSEARCH_UNTERMINATED_PIPE = 3503
    STRSEARCH_DEPTH_LESS_THAN_PATTERN = 3504
    STRSEARCH_NOT_A_PATTERN = 3505
    COULD_NOT_APPLY = 3080
    FLOW_ALREADY_ACTIVE = 3081
    FILE_EXISTS = 3083
    NO_DRIVER = 3200
    NO_DEVICE = 3202
    INIT = 6141
    FLOW_NOT_CONNECTED = 6143
    FUNCTION_NOT_FOUND = 6144
    INVALID_FLOW = 6145
    INVALID_FUNCTION_ID = 6147
    FLOW_INFO = 6149
    FUNCTION_INFO = 6150
    DEVICE_INFO = 6157
    INVALID_ARGUMENT = 7000
    INVALID_ARGUMENT_1 = 7001
    INVALID_ARGUMENT_2 = 7002
    INVALID_ARGUMENT_3 = 7003
    INVALID_ARGUMENT_4 = 7004
    INVALID_ARGUMENT_5 = 7005
    FUNCTION_COULD_NOT_APPLY = 7006
    FUNCTION_COULD_NOT_INIT = 7007
    NOT_SUPPORTED = 7009


class FlowError(ValueError):
    def __init__(self, code: Err, text: str = "") -> None:
        super().__init__(f"{int(code)} {code.name}: {text}")
        self.code = code

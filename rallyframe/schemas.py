"""Schemas of the tables; match_id leads every one."""

BALL = "match_id long, frame_idx long, x_px double, y_px double, confidence double"
PLAYERS = "match_id long, frame_idx long, track_id int, det_seq int, foot_x_px double, foot_y_px double, foot_x_m double, foot_y_m double"
POSES = "match_id long, frame_idx long, pose_seq int, pose_foot_x_px double, pose_foot_y_px double, ls_y double, rs_y double, lw_y double, rw_y double, ls_c double, rs_c double, lw_c double, rw_c double"
EVENTS = "match_id long, frame_idx long, type string, x double, y double, track_id int, confidence double"
SHOTS = "match_id long, frame_idx long, track_id int, shot_type string, confidence double"
